"""Tracking while frames arrive."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from trackspark.functions.kalman import BoxTracker

OUTPUT = "dataset STRING, kind STRING, timeframe INT, sc_id BIGINT, track_id BIGINT, n BIGINT"
STATE = (
    "frames INT, last_id BIGINT, x ARRAY<DOUBLE>, p ARRAY<DOUBLE>, ids ARRAY<BIGINT>, streak ARRAY<BIGINT>, since ARRAY<BIGINT>, "
    "done INT, late BIGINT, waiting ARRAY<STRUCT<t: INT, ts: BIGINT, sc: BIGINT, x1: DOUBLE, y1: DOUBLE, x2: DOUBLE, y2: DOUBLE>>, lengths MAP<BIGINT, BIGINT>, seen BIGINT"
)


def live_tracks(detections: DataFrame, delay: str = "10 minutes", max_age: int = 5, min_hits: int = 3, iou: float = 0.3, silence: str | None = "1 day") -> DataFrame:
    """Detections (ts, dataset, timeframe, sc_id, x1, y1, x2, y2) as a stream; event time is ts.

    A movie is a key. Detections wait in its state until the watermark has passed their time, then whole
    frames go through the tracker in order; frames without detections age the tracks. A frame at or before
    the last one done is late and dropped, as the tracker cannot go back: Spark drops detections that are
    older than the watermark (``dropped_late`` counts them), and what is newer but of a frame that is done is
    counted here. Rows of kind 'cell' carry the track of a detection, 'end' the number of cells of a track
    that expired, 'late' the number of late detections of a batch. State holds live trackers and waiting
    detections only.

    T3: a movie is over once the watermark has passed its newest detection by ``silence``: a timeout, which needs
    no further row of it, ends its live tracks as frames without detections would have, and its state is removed.
    Detections that come later still start a movie of that name anew, with tracks from 1. Without ``silence``
    movies wait for ever.
    """
    quiet = None if silence is None else int(pd.Timedelta(silence).total_seconds() * 1000)

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tracker, done, waiting, lengths, late, seen = BoxTracker(max_age, min_hits, iou), None, [], {}, 0, None
        if state.exists:
            *kept, done, _, waiting, lengths, seen = state.get
            tracker.restore(tuple(kept))
            waiting, lengths = [tuple(w) for w in waiting], dict(lengths)
        for b in batches:
            if done is not None:
                new = b["timeframe"] > done
                late += int((~new).sum())
                b = b[new]
            if len(b):
                ts = b["ts"].to_numpy("datetime64[ms]").astype(np.int64)
                waiting += zip(b["timeframe"].astype(int).tolist(), ts.tolist(), b["sc_id"].astype(int).tolist(), *(b[c].astype(float).tolist() for c in ("x1", "y1", "x2", "y2")))
                seen = int(ts.max()) if seen is None else max(seen, int(ts.max()))
        mark = state.getCurrentWatermarkMs()
        newest: dict[int, int] = {}
        for w in waiting:
            newest[w[0]] = max(newest.get(w[0], 0), w[1])
        ready = max((t for t, ts in newest.items() if ts <= mark), default=None)
        rows = []
        if ready is not None:
            frames: dict[int, list] = {}
            for w in sorted(waiting, key=lambda w: (w[0], w[2])):
                if w[0] <= ready:
                    frames.setdefault(w[0], []).append(w)
            for t in range(min(frames) if done is None else done + 1, ready + 1):
                found = frames.get(t, [])
                if not found and not len(tracker.ids):  # nothing lives
                    tracker.frames += 1
                    continue
                ids = tracker.step(np.array([w[3:] for w in found]))
                for w, i in zip(found, ids.tolist()):
                    if i:
                        lengths[i] = lengths.get(i, 0) + 1
                        rows.append(("cell", t, w[2], i, 1))
                for i in sorted(tracker.ended.tolist()):
                    if i in lengths:
                        rows.append(("end", t, None, i, lengths.pop(i)))
            waiting, done = [w for w in waiting if w[0] > ready], ready
        if late:
            rows.append(("late", done, None, None, late))
        if quiet is not None and not waiting and (seen is None or mark >= seen + quiet):
            for i, missed in sorted(zip(tracker.ids.tolist(), tracker.since.tolist())):
                if i in lengths:
                    rows.append(("end", done + max_age + 1 - missed, None, i, lengths[i]))
            state.remove()
        else:
            state.update((*tracker.state(), done, late, waiting, lengths, seen))
            if waiting:
                state.setTimeoutTimestamp(max(mark + 1, min(ts for t, ts in newest.items() if ready is None or t > ready)))
            elif quiet is not None:
                state.setTimeoutTimestamp(max(mark + 1, seen + quiet))
        if rows:
            out = pd.DataFrame(rows, columns=["kind", "timeframe", "sc_id", "track_id", "n"])
            out = out.astype({"timeframe": "Int32", "sc_id": "Int64", "track_id": "Int64", "n": "Int64"})
            out.insert(0, "dataset", key[0])
            yield out

    need = detections.withWatermark("ts", delay).select("ts", F.col("dataset").cast("string").alias("dataset"), "timeframe", "sc_id", "x1", "y1", "x2", "y2")
    return need.groupBy("dataset").applyInPandasWithState(follow, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def window_counts(detections: DataFrame, width: str, slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """T4: detections and tracks per tumbling or sliding window; batch or stream."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    d = detections.withWatermark("ts", delay)
    g = d.groupBy(w, "dataset").agg(F.count("*").alias("n_cells"), F.approx_count_distinct("track_id").alias("n_tracks"))
    return g.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "dataset", "n_cells", "n_tracks")


def activity_sessions(detections: DataFrame, gap: str, delay: str = "10 minutes") -> DataFrame:
    """T4: runs of a track's detections with no gap longer than ``gap``; batch or stream."""
    d = detections.withWatermark("ts", delay)
    g = d.groupBy(F.session_window("ts", gap), "dataset", "track_id").agg(F.count("*").alias("n_cells"))
    return g.select("dataset", "track_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n_cells")


def closed(detections: DataFrame, delay: str, dataset: str = "min(dataset)") -> DataFrame:
    """detections for a replay: with one more row, past the end by more than ``delay``, so that the watermark
    passes all others. It waits for ever in its movie's state (``dataset``, SQL) and leaves no row itself."""
    end = detections.selectExpr(
        f"max(ts) + 2 * INTERVAL {delay} AS ts", f"CAST({dataset} AS {detections.schema['dataset'].dataType.simpleString()}) AS dataset", "max(timeframe) + 1 AS timeframe",
        "CAST(-1 AS BIGINT) AS sc_id", *[f"CAST(0 AS DOUBLE) AS {k}" for k in ("x1", "y1", "x2", "y2")],
    )
    return detections.unionByName(end.where("ts IS NOT NULL"), allowMissingColumns=True)


def dropped_late(query: StreamingQuery) -> int:
    """Detections that a query has dropped so far as older than the watermark."""
    return sum(int(op["numRowsDroppedByWatermark"]) for p in query.recentProgress for op in p["stateOperators"])


def run_once(stream: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Runs a stream over what is there; its rows go to Parquet beside the checkpoint."""
    q = stream.writeStream.format("parquet").queryName(name).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(f"{checkpoint}_rows")
    q.awaitTermination()
    return q


def run_to_table(stream: DataFrame, name: str, checkpoint: str) -> DataFrame:
    """``run_once``, and all rows so far (for tests and replays)."""
    run_once(stream, name, checkpoint)
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{checkpoint}_rows")
