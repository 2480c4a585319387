"""User extensions: confirmation UDFs, whole-text scanners, adjudicators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnhelm.functions.text import find_all
from tarnhelm.schema import family_of


def register_detector(
    name: str, entity_class: str, pattern: str, confirm, text: str = "text",
    advisory: bool = False,
) -> Callable[[DataFrame], DataFrame]:
    """Detector from a pattern and a pandas UDF ``value -> confidence or null``.

    Candidates are extracted in the JVM; only the short candidate values travel to
    Python, in Arrow batches.
    """

    def run(spans: DataFrame) -> DataFrame:
        keys = [c for c in spans.columns if c != text]
        cands = spans.filter(F.col(text).rlike(pattern)).select(
            *keys, F.explode_outer(find_all(F.col(text), pattern)).alias("_m")
        ).filter("_m is not null")
        return (
            cands.withColumn("confidence", confirm(F.col("_m.value")))
            .filter("confidence is not null")
            .select(
                *keys, "_m.start", "_m.end", F.lit(entity_class).alias("entity_class"),
                family_of(F.lit(entity_class)).alias("family"), "confidence",
                F.lit(name).alias("detector"), F.lit("S0").alias("stage"),
                F.lit(1).alias("tier"), F.lit(advisory).alias("advisory_only"),
            )
        )

    return run


def register_scanner(
    name: str, scan: Callable[[str], Iterable[tuple]], text: str = "text"
) -> Callable[[DataFrame, Sequence[str]], DataFrame]:
    """Scanner from a Python function that yields (start, end, class, confidence)."""

    def run(spans: DataFrame, keys: Sequence[str]) -> DataFrame:
        keys = list(keys)
        source = spans.select(*keys, text)
        kinds = ", ".join(
            f"`{f.name}` {f.dataType.simpleString()}" for f in source.select(*keys).schema.fields
        )

        def batches(it):
            import pyarrow as pa

            types = (pa.int32(), pa.int32(), pa.string(), pa.float64())
            for batch in it:
                # One text at a time leaves the batch; keys stay in Arrow.
                at, hits = [], []
                for i, body in enumerate(batch.column(len(keys))):
                    if body.is_valid:
                        for hit in scan(body.as_py()):
                            at.append(i)
                            hits.append(hit)
                rows = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(k).take(rows) for k in range(len(keys))],
                     *[pa.array([h[k] for h in hits], t) for k, t in enumerate(types)]],
                    [*keys, "start", "end", "entity_class", "confidence"],
                )
            pa.default_memory_pool().release_unused()

        found = source.mapInArrow(
            batches, f"{kinds}, start int, end int, entity_class string, confidence double"
        )
        return found.select(
            *keys, "start", "end", "entity_class",
            family_of(F.col("entity_class")).alias("family"), "confidence",
            F.lit(name).alias("detector"), F.lit("S2").alias("stage"), F.lit(2).alias("tier"),
            F.lit(False).alias("advisory_only"),
        )

    return run
