"""Table functions for SQL: entities of notes, and a fit for each group of rows.

    register(spark)
    SELECT * FROM note_entities(TABLE(notes), '{"lexicons": {"symptom": {"cough": "S2"}}, "negations": ["no"]}')
    SELECT * FROM group_fit(TABLE(rows) PARTITION BY (site_id), 'y')

Both tell their schema from the table that they are given.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, MapType, NumericType, StringType, StructField, StructType

from hearth.operators.text import ENTITY, Extraction, extract_text

#: The columns of ENTITY, made without a session: `analyze` runs in a worker.
KINDS = {"string": StringType(), "int": IntegerType(), "map<string,string>": MapType(StringType(), StringType()), "boolean": BooleanType(), "double": DoubleType()}
COLUMNS = [StructField(c, KINDS[kind]) for c, kind in (x.split(" ", 1) for x in ENTITY.split(", "))]


def _constant(argument: AnalyzeArgument, what: str) -> str:
    if argument.isTable or not isinstance(argument.value, str):
        raise ValueError(f"{what} must be a constant string")
    return argument.value


def extraction(said: str) -> Extraction:
    """How to extract, from JSON with the names of Extraction's fields."""
    made = json.loads(said)
    return Extraction(**{k: tuple(map(tuple, v)) if k == "patterns" else tuple(v) if isinstance(v, list) else v for k, v in made.items()})


class NoteEntities:
    """The entities of each row's text; the first column names the row, the second is the text."""

    @staticmethod
    def analyze(notes: AnalyzeArgument, how: AnalyzeArgument) -> AnalyzeResult:
        if not notes.isTable or len(notes.dataType.fields) < 2 or not isinstance(notes.dataType.fields[1].dataType, StringType):
            raise ValueError("note_entities takes a table of an id and a text")
        extraction(_constant(how, "how to extract"))
        first = notes.dataType.fields[0]
        return AnalyzeResult(StructType([StructField(first.name, first.dataType), *COLUMNS]))

    def __init__(self) -> None:
        self.how: Extraction | None = None

    def eval(self, row: Row, how: str):
        self.how = self.how or extraction(how)
        if row[1]:
            for e in extract_text(row[1], self.how):
                yield (row[0], *e.values())


class GroupFit:
    """Least squares of a column on the other numeric ones and a constant, for each partition of the table.

    A group is held as its sums of products alone, whatever its number of rows.
    Rows with a null number are left out; a group that does not determine its
    coefficients gets those of least norm.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, target: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("group_fit takes a table")
        said = _constant(target, "the column to fit")
        names = [f.name for f in rows.dataType.fields if isinstance(f.dataType, NumericType)]
        if said not in names:
            raise ValueError(f"no numeric column {said}")
        return AnalyzeResult(StructType([StructField("n", LongType()), StructField("features", ArrayType(StringType())), StructField("coefficients", ArrayType(DoubleType()))]))

    def __init__(self) -> None:
        self.n, self.names, self.products, self.moments = 0, None, None, None

    def eval(self, row: Row, target: str):
        values = {k: v for k, v in row.asDict().items() if isinstance(v, (int, float)) and not isinstance(v, bool) or v is None}
        if self.names is None:
            self.names = [k for k in row.__fields__ if k in values and k != target]
            self.products, self.moments = np.zeros((len(self.names) + 1,) * 2), np.zeros(len(self.names) + 1)
        x = [values.get(k) for k in self.names]
        if values.get(target) is not None and None not in x:
            x = np.array([*map(float, x), 1.0])
            self.products += np.outer(x, x)
            self.moments += x * float(values[target])
            self.n += 1

    def terminate(self):
        if self.n:
            found = np.linalg.lstsq(self.products, self.moments, rcond=None)[0]
            yield self.n, [*self.names, "constant"], found.tolist()


@dataclass
class Told(AnalyzeResult):
    """What `analyze` found, for the workers: the columns to sum, the one to fit last."""

    names: tuple[str, ...] = ()


class GroupSums:
    """Sums of products for a fit, for each partition of the table; the first column names the group.

    A group may be dealt over many partitions: group_solved adds their sums.
    """

    BLOCK = 4096

    @staticmethod
    def analyze(rows: AnalyzeArgument, target: AnalyzeArgument) -> Told:
        if not rows.isTable:
            raise ValueError("group_sums takes a table")
        said, (first, *rest) = _constant(target, "the column to fit"), rows.dataType.fields
        names = [f.name for f in rest if isinstance(f.dataType, NumericType)]
        if said not in names:
            raise ValueError(f"no numeric column {said}")
        names.remove(said)
        sums = [StructField(c, ArrayType(DoubleType())) for c in ("products", "moments")]
        return Told(StructType([StructField(first.name, first.dataType), StructField("n", LongType()), StructField("features", ArrayType(StringType())), *sums]), names=(*names, said))

    def __init__(self, told: Told) -> None:
        self.names, self.at, self.key, self.n, self.held = told.names, None, None, 0, []
        self.sums = np.zeros((len(self.names), len(self.names) + 1))

    def add(self) -> None:
        if self.held:
            x = np.array(self.held, np.float64)
            features = np.column_stack([x[:, :-1], np.ones(len(x))])
            self.sums += features.T @ np.column_stack([features, x[:, -1]])
            self.n, self.held = self.n + len(x), []

    def eval(self, row: Row, target: str):
        if self.at is None:
            self.key, self.at = row[0], [row.__fields__.index(c) for c in self.names]
        values = [row[i] for i in self.at]
        if None not in values:
            self.held.append(values)
            if len(self.held) >= self.BLOCK:
                self.add()

    def terminate(self):
        self.add()
        if self.n:
            yield self.key, self.n, [*self.names[:-1], "constant"], self.sums[:, :-1].ravel().tolist(), self.sums[:, -1].tolist()


class GroupSolved:
    """The fit of each partition of rows of group_sums, a row for each part of a group; as from group_fit."""

    @staticmethod
    def analyze(sums: AnalyzeArgument) -> AnalyzeResult:
        if not sums.isTable or [f.name for f in sums.dataType.fields][1:] != ["n", "features", "products", "moments"]:
            raise ValueError("group_solved takes rows of group_sums")
        return AnalyzeResult(StructType([StructField("n", LongType()), StructField("features", ArrayType(StringType())), StructField("coefficients", ArrayType(DoubleType()))]))

    def __init__(self) -> None:
        self.n, self.names, self.products, self.moments = 0, None, 0.0, 0.0

    def eval(self, row: Row):
        k = len(row["features"])
        self.names, self.n = row["features"], self.n + row["n"]
        self.products, self.moments = self.products + np.array(row["products"]).reshape(k, k), self.moments + np.array(row["moments"])

    def terminate(self):
        if self.n:
            yield self.n, self.names, np.linalg.lstsq(self.products, self.moments, rcond=None)[0].tolist()


def register(spark: SparkSession) -> None:
    """note_entities, group_fit, group_sums and group_solved as functions of the session's SQL."""
    spark.udtf.register("note_entities", udtf(NoteEntities))
    spark.udtf.register("group_fit", udtf(GroupFit))
    spark.udtf.register("group_sums", udtf(GroupSums))
    spark.udtf.register("group_solved", udtf(GroupSolved))
