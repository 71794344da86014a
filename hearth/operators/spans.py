"""Matching of predicted spans with a gold standard, and scores from it."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearth.functions.numbers import safe_ratio

MATCH = "doc_id long, kind string, outcome string, gold_start int, pred_start int"


def merged(gold: list[tuple[int, int]], predicted: list[tuple[int, int]], tolerance: int, overlap: bool) -> list[tuple[str, int | None, int | None]]:
    """(outcome, gold start, predicted start) of two lists of spans, each sorted by start and end.

    One merge: predictions enter a window once a gold span's reach comes to their
    start, and leave it when matched or when gold spans have gone past them.  A
    gold span takes the first prediction of the window that is close.
    """
    out: list[tuple[str, int | None, int | None]] = []
    window: list[tuple[int, int]] = []
    at = 0
    for start, end in gold:
        while at < len(predicted) and (predicted[at][0] < end if overlap else predicted[at][0] <= start + tolerance):
            window.append(predicted[at])
            at += 1
        past = [p for p in window if (p[1] <= start if overlap else p[0] < start - tolerance)]
        out += [("fp", None, p[0]) for p in past]
        window = [p for p in window if not (p[1] <= start if overlap else p[0] < start - tolerance)]
        hit = next((k for k, p in enumerate(window) if (p[0] < end if overlap else abs(p[1] - end) <= tolerance)), None)
        out.append(("fn", start, None) if hit is None else ("tp", start, window.pop(hit)[0]))
    return out + [("fp", None, p[0]) for p in (*window, *predicted[at:])]


def matched(gold: DataFrame, predicted: DataFrame, tolerance: int = 3, overlap: bool = False) -> DataFrame:
    """tp, fn and fp rows by document and kind.

    Spans (doc_id, kind, char_start, char_end) match if both ends lie within the
    tolerance, or, with `overlap`, if they overlap.  Matching is greedy in the
    order of gold spans, then of predictions.  A document's spans of one kind are
    one row's arrays; many documents go to Python together.
    """
    span = F.struct("char_start", "char_end")
    both = gold.select("doc_id", "kind", span.alias("g"), F.lit(None).cast("struct<char_start:int,char_end:int>").alias("p")).unionByName(predicted.select("doc_id", "kind", F.lit(None).cast("struct<char_start:int,char_end:int>").alias("g"), span.alias("p")))
    sides = both.groupBy(F.col("doc_id").cast("long").alias("doc_id"), "kind").agg(*[F.sort_array(F.collect_list(c)).alias(c) for c in ("g", "p")])

    def run(batches):
        for part in (batch.slice(at, 256) for batch in batches for at in range(0, batch.num_rows, 256)):
            docs, kinds, out = part.column(0), part.column(1), []
            for k, (g, p) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist())):
                g, p = ([(s["char_start"], s["char_end"]) for s in side] for side in (g, p))
                out += [(k, *row) for row in merged(g, p, tolerance, overlap)]
            if out:
                at, outcome, a, b = zip(*out)
                yield pa.RecordBatch.from_arrays([docs.take(pa.array(at)), kinds.take(pa.array(at)), pa.array(outcome), pa.array(a, pa.int32()), pa.array(b, pa.int32())], names=["doc_id", "kind", "outcome", "gold_start", "pred_start"])

    return sides.mapInArrow(run, MATCH)


def scores(outcomes: DataFrame, keys: list[str]) -> DataFrame:
    """tp, fp, fn, precision, recall and F1 by key, and over all keys (nulls) in one pass."""
    sums = outcomes.rollup(*keys) if keys else outcomes.groupBy()
    counted = sums.agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in ("tp", "fp", "fn")])
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counted.withColumn("precision", safe_ratio(tp, tp + fp)).withColumn("recall", safe_ratio(tp, tp + fn)).withColumn("f1", safe_ratio(2 * tp, 2 * tp + fp + fn))
