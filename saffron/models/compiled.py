"""Fitted pipelines as one expression, so that rows are scored without an ML transform.

A pipeline of indexers, one-hot encoders, imputers, an assembler and a linear model, a
forest or boosted trees becomes SQL text over the input's own columns: trees turn into
nested CASE expressions. The text runs in Spark, where Catalyst prunes and pushes down
around it, and unchanged in other engines. Its size is that of the model.

Null features without an imputer give a null prediction; a category that the fit never saw
belongs to no indicator, as in the pipeline.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, LogisticRegressionModel, RandomForestClassificationModel
from pyspark.ml.feature import ImputerModel, OneHotEncoderModel, StringIndexerModel, VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, LinearRegressionModel, RandomForestRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Characters of an expression that Spark still compiles well.
LARGE = 8000


def number(x: float) -> str:
    """A double literal of both dialects."""
    text = repr(float(x))
    text = text if "e" in text else f"{text}e0"
    return f"({text})" if text.startswith("-") else text


def name(column: str) -> str:
    return column if re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", column) else '"' + column + '"'


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


@dataclass(frozen=True)
class Indicator:
    """A slot that is 1 where a column holds a category."""

    column: str
    category: str

    def test(self) -> str:
        return f"{name(self.column)} = {text(self.category)}"


Slot = Indicator | str


def slots_of(stages: list) -> list[Slot]:
    """What stands in each place of the assembled vector, as an expression over the input."""
    index: dict[str, tuple[str, list[str]]] = {}
    known: dict[str, list[Slot]] = {}
    out: list[Slot] = []
    for s in stages:
        if isinstance(s, StringIndexerModel):
            inputs = s.getInputCols() if s.isSet(s.inputCols) else [s.getInputCol()]
            outputs = s.getOutputCols() if s.isSet(s.outputCols) else [s.getOutputCol()]
            for i, o, labels in zip(inputs, outputs, s.labelsArray, strict=True):
                index[o] = i, list(labels)
        elif isinstance(s, OneHotEncoderModel):
            inputs = s.getInputCols() if s.isSet(s.inputCols) else [s.getInputCol()]
            outputs = s.getOutputCols() if s.isSet(s.outputCols) else [s.getOutputCol()]
            for i, o, size in zip(inputs, outputs, s.categorySizes, strict=True):
                column, labels = index[i]
                # Of its categories, the unknown one of "keep" among them, the last has no slot.
                sized = size + (s.getHandleInvalid() == "keep") - bool(s.getDropLast())
                known[o] = [Indicator(column, c) for c in labels[:sized]] + ["0e0"] * (sized - len(labels))
        elif isinstance(s, ImputerModel):
            fill = s.surrogateDF.first().asDict()
            for i, o in zip(s.getInputCols(), s.getOutputCols(), strict=True):
                known[o] = [f"coalesce({name(i)}, {number(fill[i])})"]
        elif isinstance(s, VectorAssembler):
            out = [x for c in s.getInputCols() for x in known.get(c, [name(c)])]
    return out


def value(slot: Slot) -> str:
    return f"CASE WHEN {slot.test()} THEN 1e0 ELSE 0e0 END" if isinstance(slot, Indicator) else slot


def weighted(slots: list[Slot], weights: list[float], intercept: float) -> str:
    """A sum; slots without weight are left out, the indicators of a column become one CASE."""
    parts, cases = [number(intercept)], {}
    for s, w in zip(slots, weights, strict=True):
        if isinstance(s, Indicator):
            cases.setdefault(s.column, []).append((s, w))
        elif w and s != "0e0":
            parts.append(f"{number(w)} * {s}")
    for each in cases.values():
        parts.append("CASE " + " ".join(f"WHEN {s.test()} THEN {number(w)}" for s, w in each) + " ELSE 0e0 END")
    return " + ".join(parts)


_SPLIT = re.compile(r"(If|Else) \(feature (\d+) (<=|>|in|not in) (\{[^}]*\}|[-+.\deE]+)\)")


def _printed(lines: Iterator[str], slots: list[Slot]) -> str:
    """One node of a printed tree, and what is below it."""
    line = next(lines).strip()
    if line.startswith("Predict:"):
        return number(float(line[8:]))
    _, slot, how, cut = _SPLIT.match(line).groups()
    low = _printed(lines, slots)
    next(lines)  # the same split, turned round
    high = _printed(lines, slots)
    return _case(slots[int(slot)], how, cut, low, high)


def _case(slot: Slot, how: str, cut: str, low: str, high: str) -> str:
    if how == "<=":
        test = f"{value(slot)} <= {number(float(cut))}"
    else:
        test = f"{value(slot)} IN ({', '.join(number(float(x)) for x in cut.strip('{}').split(','))})"
    return f"CASE WHEN {test} THEN {low} ELSE {high} END"


def printed_trees(model, slots: list[Slot]) -> list[str]:
    """Each tree of an ensemble of regression trees, from its printed form."""
    trees: list[list[str]] = []
    for line in model.toDebugString.splitlines()[1:]:
        if re.match(r"\s*Tree \d+", line):
            trees.append([])
        elif line.strip():
            trees[-1].append(line)
    return [_printed(iter(t), slots) for t in trees]


def class_tree(tree, slots: list[Slot]) -> str:
    """The share of label 1 in each leaf of a classification tree, which the printed form lacks."""

    def walk(node) -> str:
        if node.subtreeDepth() == 0:
            stats = list(node.impurityStats().stats())
            return number(stats[1] / sum(stats) if sum(stats) else 0.0)
        split = node.split()
        slot = slots[split.featureIndex()]
        low, high = walk(node.leftChild()), walk(node.rightChild())
        if "Categorical" in split.getClass().getSimpleName():
            return _case(slot, "in", ",".join(str(x) for x in split.leftCategories()), low, high)
        return _case(slot, "<=", repr(split.threshold()), low, high)

    return walk(tree._java_obj.rootNode())


def _logistic(x: str, times: int = 1) -> str:
    return f"1e0 / (1e0 + exp(-({f'{times}e0 * ' if times > 1 else ''}({x}))))"


def _sum(trees: list[str], weights: list[float]) -> str:
    return " + ".join(f"{number(w)} * ({t})" for t, w in zip(trees, weights, strict=True))


#: The prediction of a regression, or the probability of label 1.
FORMS: dict[type, Callable] = {
    LinearRegressionModel: lambda m, s: weighted(s, m.coefficients.toArray().tolist(), m.intercept),
    LogisticRegressionModel: lambda m, s: _logistic(weighted(s, m.coefficients.toArray().tolist(), m.intercept)),
    RandomForestRegressionModel: lambda m, s: f"({' + '.join(f'({t})' for t in printed_trees(m, s))}) / {number(m.getNumTrees)}",
    GBTRegressionModel: lambda m, s: _sum(printed_trees(m, s), m.treeWeights),
    GBTClassificationModel: lambda m, s: _logistic(_sum(printed_trees(m, s), m.treeWeights), 2),
    RandomForestClassificationModel: lambda m, s: f"({' + '.join(f'({class_tree(t, s)})' for t in m.trees)}) / {number(m.getNumTrees)}",
}


_QUOTED = re.compile(r"'(?:[^']|'')*'|\"[^\"]*\"")


def _spark_form(m: re.Match) -> str:
    """A quoted text or name as Spark writes it."""
    if m[0][0] == '"':
        return f"`{m[0][1:-1]}`"
    plain = m[0][1:-1].replace("''", "'")
    return "'" + plain.replace("\\", "\\\\").replace("'", "\\'") + "'"


@dataclass(frozen=True)
class Scorer:
    """A fitted pipeline's prediction as SQL over its input columns."""

    sql: str
    columns: tuple[str, ...]

    def column(self) -> Column:
        """Large trees are evaluated inside a lambda, for no generated method could hold them."""
        own = _QUOTED.sub(_spark_form, self.sql)
        return F.expr(own if len(own) < LARGE else f"element_at(transform(array(0), _one -> {own}), 1)")

    def score(self, rows: DataFrame, out: str = "prediction") -> DataFrame:
        return rows.withColumn(out, self.column())

    def one(self, spark: SparkSession, row: dict) -> float | None:
        """The score of one row; a local relation, which Spark evaluates without a job."""
        kinds = ", ".join(f"`{c}` {'string' if isinstance(row[c], str) else 'double'}" for c in self.columns)
        return self.score(spark.createDataFrame([tuple(row[c] if isinstance(row[c], str) or row[c] is None else float(row[c]) for c in self.columns)], kinds)).first()["prediction"]


def compiled(model: PipelineModel) -> Scorer:
    """The scorer of a fitted pipeline."""
    *before, last = model.stages
    form = FORMS.get(type(last))
    if form is None:
        raise TypeError(f"no expression for {type(last).__name__}")
    return Scorer(form(last, slots_of(before)), tuple(sorted(_columns(before, "input") - _columns(before, "output"))))


def _columns(stages: list, side: str) -> set[str]:
    """Columns that stages take (``input``) or make (``output``)."""
    out: set[str] = set()
    for s in stages:
        for p in (f"{side}Col", f"{side}Cols"):
            if s.hasParam(p) and s.isSet(s.getParam(p)):
                got = s.getOrDefault(s.getParam(p))
                out |= {got} if isinstance(got, str) else set(got)
    return out
