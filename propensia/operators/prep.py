"""Preprocessing estimator (P1-P6): impute, ordinal-encode, assemble.

Fitted state: one median or mode per column (bounded, literal expressions at
transform time) and the category codes, which may be as many as there are
rows and therefore stay a DataFrame.

Codes are looked up by a hybrid join.  Values that hold at least ``HOT_SHARE``
of a column's rows -- no more than 1 / HOT_SHARE of them -- are a constant map,
so a value with a third of all rows is never exchanged.  The other values of
all columns are melted to (row, column, value) and looked up by one join
whatever the number of columns; the codes found come back by row number.
Where every value is hot nothing is exchanged at all.

Medians (``medians``) are exact from two scans, or approximate from one.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir
from .medians import SKETCH_ACCURACY, approx_medians, exact_medians, number  # noqa: F401
from .rank import rank_within_groups

CODES_SCHEMA = "c int, v string, code double"
HOT_SHARE = 0.01            # of a column's rows, which make a value part of the constant map


def split_column_kinds(df: DataFrame, exclude: list[str]) -> tuple[list[str], list[str]]:
    """categorical = string columns, numeric = everything else, in frame order."""
    cat, num = [], []
    for f in df.schema.fields:
        if f.name in exclude:
            continue
        (cat if isinstance(f.dataType, T.StringType) else num).append(f.name)
    return cat, num


def category_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column index, value, rows) of every distinct category value, partially aggregated before the shuffle."""
    if not cols:
        return df.sparkSession.createDataFrame([], "c int, v string, cnt long")
    items = [F.struct(F.lit(i).alias("c"), F.col(c).cast("string").alias("v")) for i, c in enumerate(cols)]
    pairs = df.select(F.explode(F.array(*items)).alias("s")).select("s.c", "s.v").where(F.col("v").isNotNull())
    return pairs.groupBy("c", "v").agg(F.count(F.lit(1)).alias("cnt"))


def most_frequent(counts: DataFrame) -> DataFrame:
    """(column index, mode) from ``category_counts``: highest count, ties to the smallest value."""
    return counts.groupBy("c").agg(F.min_by("v", F.struct((-F.col("cnt")).alias("k"), F.col("v"))).alias("mode"))


def category_codes(counts: DataFrame) -> DataFrame:
    """(column index, value, code): 0-based position of a value in its column's sorted values, any number of them."""
    ranked = rank_within_groups(counts.select("c", "v"), "c", [F.col("v").asc()], rank_col="_pos")
    return ranked.select("c", "v", (F.col("_pos") - 1).cast("double").alias("code"))


@dataclass
class LeadEncoderModel:
    """Fitted imputer + ordinal encoder + assembler state."""

    cat_cols: list[str]
    num_cols: list[str]
    modes: dict[str, str] = field(default_factory=dict)
    medians: dict[str, float] = field(default_factory=dict)
    codes: DataFrame | None = None            # CODES_SCHEMA, c = position in cat_cols
    output_col: str = "features"
    hot: dict[str, dict[str, float]] = field(default_factory=dict)    # column -> value -> code of the frequent values
    all_hot: bool = False                     # whether ``hot`` holds every value

    @property
    def used_num_cols(self) -> list[str]:
        return [c for c in self.num_cols if c in self.medians]

    @property
    def used_cat_cols(self) -> list[str]:
        return [c for c in self.cat_cols if c in self.modes]

    def feature_names(self) -> list[str]:
        """``cat__x`` then ``num__y``."""
        return [f"cat__{c}" for c in self.used_cat_cols] + [f"num__{c}" for c in self.used_num_cols]

    def encoded(self, df: DataFrame, keep: list[str]) -> DataFrame:
        """``keep`` columns and one column per feature; a value that was not fitted gets -1."""
        values = [F.coalesce(F.col(c).cast("string"), F.lit(self.modes[c])).alias(f"cat__{c}") for c in self.used_cat_cols]
        numbers = [F.coalesce(number(c), F.lit(float(self.medians[c]))).alias(f"num__{c}") for c in self.used_num_cols]
        rows = df.select(*keep, *values, *numbers)
        found = {c: self._hot_code(c) for c in self.used_cat_cols}
        if not self.all_hot and self.used_cat_cols:
            rows, cold = self._cold_codes(rows, found)
            found = {c: F.coalesce(f, F.get(cold, F.lit(i))) for i, (c, f) in enumerate(found.items())}
        codes = [F.coalesce(found[c], F.lit(-1.0)).alias(f"cat__{c}") for c in self.used_cat_cols]
        return rows.select(*keep, *codes, *[f"num__{c}" for c in self.used_num_cols])

    def _hot_code(self, c: str) -> Column:
        """Code of a frequent value from a constant map, else null."""
        hot = self.hot.get(c)
        if not hot:
            return F.lit(None).cast("double")
        table = F.from_json(F.lit(json.dumps(hot)), "map<string,double>")
        return F.element_at(table, F.col(f"cat__{c}"))

    def _cold_codes(self, rows: DataFrame, found: dict[str, Column]) -> tuple[DataFrame, Column]:
        """``rows`` with the codes of their other values (array by position in ``used_cat_cols``) joined by row number.

        The rows are checkpointed, so that numbers and rows stay together if
        an executor is lost.
        """
        ensure_checkpoint_dir(rows.sparkSession)
        rows = rows.withColumn("_row", F.monotonically_increasing_id()).checkpoint()
        items = [F.when(f.isNull(), F.struct(F.lit(self.cat_cols.index(c)).alias("c"), F.col(f"cat__{c}").alias("v"),
                                             F.lit(i).alias("i"))) for i, (c, f) in enumerate(found.items())]
        melted = rows.select("_row", F.explode(F.array_compact(F.array(*items))).alias("s")).select("_row", "s.*")
        pairs = melted.join(self.codes, ["c", "v"]).groupBy("_row").agg(
            F.map_from_entries(F.collect_list(F.struct("i", "code"))).alias("_m"))      # at most one entry per column
        codes = F.array(*[F.element_at("_m", F.lit(i)) for i in range(len(found))])
        return rows.join(pairs.select("_row", codes.alias("_codes")), "_row", "left"), F.col("_codes")

    def transform(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        """Imputed, encoded columns assembled into one vector."""
        keep = [c for c in (keep or []) if c in df.columns]
        assembler = VectorAssembler(inputCols=self.feature_names(), outputCol=self.output_col, handleInvalid="keep")
        return assembler.transform(self.encoded(df, keep)).select(*keep, self.output_col)

    def to_json(self) -> str:
        """Everything but the codes, which are saved as a table."""
        return json.dumps({"cat_cols": self.cat_cols, "num_cols": self.num_cols, "modes": self.modes,
                           "medians": self.medians, "output_col": self.output_col, "hot": self.hot, "all_hot": self.all_hot})

    @classmethod
    def from_json(cls, text: str, codes: DataFrame) -> "LeadEncoderModel":
        return cls(**json.loads(text), codes=codes)


class LeadEncoder:
    """P2-P4 estimator: most-frequent / median imputation and ordinal codes."""

    def __init__(self, cat_cols: list[str], num_cols: list[str], output_col: str = "features", approx: bool = False):
        self.cat_cols = list(cat_cols)
        self.num_cols = list(num_cols)
        self.output_col = output_col
        self.approx = approx          # medians from the sketch alone

    def fit(self, df: DataFrame) -> LeadEncoderModel:
        middle = approx_medians if self.approx else exact_medians
        medians = {self.num_cols[r["c"]]: r["median"] for r in middle(df, self.num_cols).collect()}
        ensure_checkpoint_dir(df.sparkSession)
        counts = category_counts(df, self.cat_cols).checkpoint()
        modes = {self.cat_cols[r["c"]]: r["mode"] for r in most_frequent(counts).collect()}    # one row per column
        codes = category_codes(counts).checkpoint()
        sizes = counts.groupBy("c").agg(F.sum("cnt").alias("n"), F.count(F.lit(1)).alias("k"))
        common = counts.join(sizes, "c").where(F.col("cnt") >= F.col("n") * HOT_SHARE).select("c", "v")
        hot: dict[str, dict[str, float]] = {}
        for r in codes.join(common, ["c", "v"]).collect():         # at most 1 / HOT_SHARE values per column
            hot.setdefault(self.cat_cols[r["c"]], {})[r["v"]] = r["code"]
        n_values = sizes.agg(F.sum("k")).first()[0] or 0
        return LeadEncoderModel(self.cat_cols, self.num_cols, modes, medians, codes, self.output_col, hot,
                                n_values == sum(map(len, hot.values())))
