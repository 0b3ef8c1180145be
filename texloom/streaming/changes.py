"""Changes of annotations and jobs as streams of files: an addition to the batch folds of operators.library."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHANGE = "id string, revision int, deleted boolean, comment string, at timestamp"


def read_changes(spark: SparkSession, path: str, schema: str = CHANGE) -> DataFrame:
    return spark.readStream.schema(schema).json(path)


def _fold(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    revision, deleted, comment = state.get if state.exists else (0, False, None)
    rows = pd.concat(list(frames)).sort_values(["at", "revision"], kind="stable")
    applied = refused = 0
    for asked, gone, said in rows[["revision", "deleted", "comment"]].itertuples(index=False, name=None):
        if asked == revision and not deleted:
            revision, deleted, comment, applied = revision + 1, bool(gone), said if said is not None else comment, applied + 1
        else:
            refused += 1
    state.update((revision, deleted, comment))
    yield pd.DataFrame({"id": [key[0]], "revision": [revision], "deleted": [deleted], "comment": [comment], "applied": [applied], "refused": [refused]})


def patched(changes: DataFrame) -> DataFrame:
    """UP1: a change counts if it names the current revision, which it raises; a deleted row takes none."""
    return changes.groupBy("id").applyInPandasWithState(_fold, "id string, revision int, deleted boolean, comment string, applied int, refused int", "revision int, deleted boolean, comment string", "update", "NoTimeout")


def patched_batch(changes: DataFrame, modulus: int | None = None) -> DataFrame:
    """UP1 in batch: (id, revision, deleted, value, applied, refused) after changes (id, at, asked, gone, value), in order of at.

    A change counts if it asks for the current revision (or for its remainder by modulus, where names of revisions
    come round), which it raises, and the row is not deleted; value is that of the last change that counted.  Rows are
    sorted by Spark and folded as they stream by, so that an id with any number of changes takes a few numbers of memory.
    Changes without an id are left out; a null revision is never the current one.
    """
    rows = changes.where("id is not null").select("id", "at", F.col("asked").cast("long").alias("asked"), F.coalesce("gone", F.lit(False)).alias("gone"), "value")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    names = ["id", "revision", "deleted", "value", "applied", "refused"]

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for frame in frames:
            out = []
            asked = frame["asked"].astype("Int64").tolist()
            for key, wanted, gone, value in zip(frame["id"].tolist(), asked, frame["gone"].tolist(), frame["value"].tolist()):
                if held is None or held[0] != key:
                    if held is not None:
                        out.append(tuple(held))
                    held = [key, 0, False, None, 0, 0]
                now = held[1] if modulus is None else held[1] % modulus
                if not held[2] and wanted is not pd.NA and wanted == now:
                    held[1:5] = held[1] + 1, bool(gone), value, held[4] + 1
                else:
                    held[5] += 1
            yield pd.DataFrame(out, columns=names)
        if held is not None:
            yield pd.DataFrame([tuple(held)], columns=names)

    dealt = rows.repartition("id").sortWithinPartitions("id", "at", "asked", "value")
    return dealt.mapInPandas(fold, f"id {kinds['id']}, revision long, deleted boolean, value {kinds['value']}, applied long, refused long")


def changed_parents(changes: DataFrame, children: DataFrame) -> DataFrame:
    """PL2: parents whose children changed in a batch, for use in foreachBatch; children is (id, parent_id)."""
    return changes.select("id").distinct().join(children, "id").select("parent_id").distinct()


def windowed(events: DataFrame, late: str = "10 minutes", width: str = "1 minute") -> DataFrame:
    """PL1: events (at, status) by window and status; rows later than the watermark are left out."""
    return events.withWatermark("at", late).groupBy(F.window("at", width), "status").count()
