"""Documents as a stream: every micro-batch refreshes the stored corpus; listings as a stream: what each path did."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestone.plans.refresh import refresh_stored
from lodestone.sources.corpus import latest_version


def apply_batch(batch: DataFrame, path: str, as_of: float) -> None:
    """Add new and changed documents of one batch. A stream never says what is gone.

    The last row of a path wins. Running a batch twice changes nothing the second time,
    as all its rows are then unchanged.
    """
    spark = batch.sparkSession
    assert latest_version(spark, path) is not None, f"no corpus at {path}"
    latest = batch.groupBy("normalized_path").agg(
        F.max_by(F.struct(*[c for c in batch.columns if c != "normalized_path"]), "mtime").alias("r")
    ).select("normalized_path", "r.*")
    refresh_stored(path, latest, "/", as_of, delete_missing=False)


def refresh_stream(documents: DataFrame, path: str, checkpoint: str, as_of: float) -> DataStreamWriter:
    return documents.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, _id: apply_batch(batch, path, as_of)
    )


CHANGES = "normalized_path string, change string, listed_at timestamp, size bigint, mtime double"
_STATE = "paths array<string>, mtimes array<double>, sizes array<bigint>, seen array<timestamp>"
#: Groups that the paths are dealt to by their hash; fixed for the life of a stream's checkpoint.
GROUPS = 1_024


def path_changes(listings: DataFrame, gone_after: str = "1 hour", lateness: str = "0 seconds", groups: int = GROUPS) -> DataFrame:
    """What a stream of listings says about each path: new, changed, unchanged, and gone.

    ``listings`` holds (normalized_path, mtime, size, listed_at); a root is listed again and again. The state says of each
    path what it was and when it was last seen. A path that has not been listed for ``gone_after`` of event time, while
    other listings went on, is gone and leaves the state; if it comes back it is new. Of several rows of a path in
    one batch each is judged, in order of their times. The paths of a group are one state and one call of a worker, which
    costs milliseconds whatever it holds; a worker holds one group, so streams of hundreds of millions of paths want more ``groups``.
    """
    limit = pd.Timedelta(gone_after)

    def judge(_key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known, told, watermark = {}, [], state.getCurrentWatermarkMs()
        if state.exists:
            known = {path: (mtime, size, pd.Timestamp(seen)) for path, mtime, size, seen in zip(*state.get, strict=True)}
        listed = set()
        if not state.hasTimedOut:
            found = pd.concat(list(batches)).sort_values(["listed_at", "mtime", "size"])
            for row in found.itertuples():
                path, was = row.normalized_path, known.get(row.normalized_path)
                change = "new" if was is None else "unchanged" if was[:2] == (row.mtime, row.size) else "changed"
                if was is not None and row.listed_at - was[2] > limit:
                    change = "new"
                known[path] = (float(row.mtime), int(row.size), max(row.listed_at, was[2]) if was else row.listed_at)
                told.append((path, change, row.listed_at, row.size, row.mtime))
                listed.add(path)
        due = {path: int((seen + limit).timestamp() * 1000) for path, (_, _, seen) in known.items()}
        for path in [path for path, at in due.items() if at < watermark and path not in listed]:
            mtime, size, seen = known.pop(path)
            told.append((path, "gone", seen + limit, size, mtime))
        if known:
            mtimes, sizes, times = zip(*known.values(), strict=True)
            state.update((list(known), list(mtimes), list(sizes), [t.to_pydatetime() for t in times]))
            state.setTimeoutTimestamp(max(min(due[path] for path in known), watermark + 1))
        else:
            state.remove()
        yield pd.DataFrame(told, columns=["normalized_path", "change", "listed_at", "size", "mtime"])

    rows = listings.select("normalized_path", "mtime", F.col("size").cast("bigint").alias("size"), "listed_at")
    return (
        rows.withWatermark("listed_at", lateness)
        .withColumn("dealt", F.pmod(F.xxhash64("normalized_path"), F.lit(groups)))
        .groupBy("dealt")
        .applyInPandasWithState(judge, CHANGES, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    )
