"""Key joins in which the right side's keys are unique and unmatched rows read as zero.

All are plain equi-joins: Catalyst picks broadcast or sort-merge by the sizes it knows, and
adaptive execution splits skewed keys. Where keys repeat on both sides, rows meet in blocks
(`expand`), as the result may be larger than both sides by any factor.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Keys = str | Sequence[str]

#: Rows of a key that meet those of the other side at once (generated code keeps all rows that a pair
#: of blocks makes until it hands them on), and rows that a task makes.
BLOCK, MADE = 128, 1 << 22


class DuplicateKeyError(ValueError):
    pass


def keys_of(keys: Keys) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def _known_unique(df: DataFrame, cols: list[str]) -> bool:
    """Whether the plan itself tells that the columns are a key: after a distinct or an aggregate by them."""
    try:
        found = df._jdf.queryExecution().optimizedPlan().distinctKeys().toSeq()
        sets = [found.apply(i).toSeq() for i in range(found.size())]
        return any({own.apply(i).name() for i in range(own.size())} <= set(cols) for own in sets)
    except Exception:  # no such knowledge in this kind of session: the keys are counted
        return False


def check_unique(df: DataFrame, keys: Keys) -> DataFrame:
    """df, or DuplicateKeyError if two rows share a key without nulls. Costs one aggregate, unless
    the plan makes the key unique."""
    cols = keys_of(keys)
    if _known_unique(df, cols):
        return df
    found = df.dropna(subset=cols).groupBy(*cols).count().where("count > 1").limit(1).collect()
    if found:
        raise DuplicateKeyError(f"key {tuple(found[0][c] for c in cols)} occurs {found[0]['count']} times")
    return df


def zero_of(kind: T.DataType) -> Column:
    """What an unmatched cell reads as: zero, false, the empty text."""
    if isinstance(kind, T.BooleanType):
        return F.lit(False)
    if isinstance(kind, T.StringType):
        return F.lit("")
    if isinstance(kind, T.BinaryType):
        return F.lit(b"")
    if isinstance(kind, T.NumericType):
        return F.lit(0).cast(kind)
    return F.lit(None).cast(kind)


def _tagged(right: DataFrame, keys: list[str], columns: Sequence[str]) -> DataFrame:
    """The right side under names that cannot clash, with a mark that tells a match."""
    return right.select(*(F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)), *(F.col(f"`{c}`").alias(f"_r{i}") for i, c in enumerate(columns)), F.lit(True).alias("_hit"))


def _on(left: DataFrame, keys: list[str]) -> Column:
    out = F.lit(True)
    for i, k in enumerate(keys):
        out = out & (left[f"`{k}`"] == F.col(f"_k{i}"))
    return out


def join(left: DataFrame, right: DataFrame, left_key: Keys, right_key: Keys, left_columns: Sequence[str], right_columns: Sequence[str] = (), *, unique: bool = True) -> DataFrame:
    """Inner join. Left keys may repeat; right keys may not, unless `unique` is False (then rows multiply)."""
    lk, rk = keys_of(left_key), keys_of(right_key)
    if not unique:
        return expand(left, right, lk, rk, left_columns, right_columns)
    check_unique(right, rk)
    r = _tagged(right, rk, right_columns)
    return left.join(r, _on(left, lk)).select(*(left[f"`{c}`"] for c in left_columns), *(F.col(f"_r{i}").alias(c) for i, c in enumerate(right_columns)))


def _keyed(df: DataFrame, keys: list[str], columns: Sequence[str], side: str) -> DataFrame:
    """The rows that have a key, under names that tell the side."""
    own = df.select(*(F.col(f"`{k}`").alias(f"_{side}k{i}") for i, k in enumerate(keys)), *(F.col(f"`{c}`").alias(f"_{side}{i}") for i, c in enumerate(columns)))
    return own.where(" AND ".join(f"_{side}k{i} IS NOT NULL" for i in range(len(keys))))


def _blocks(rows: DataFrame, keys: int, most: int, side: str) -> DataFrame:
    """Arrays of about BLOCK rows of a key, where no key has more than `most`. A hash of the row deals
    them out, so that a task that runs twice gives the same ones; copies are counted, and dealt too."""
    ks, cols = rows.columns[:keys], rows.columns[keys:]
    pieces = rows.groupBy(*rows.columns).agg(F.count("*").alias("_n")).withColumn("_p", F.explode(F.expr(f"sequence(0L, (_n - 1) div {BLOCK})")))
    times = F.least(F.lit(BLOCK), F.col("_n") - F.col("_p") * BLOCK).cast("int")
    hashed = [f.name for f in rows.schema[keys:] if "map<" not in f.dataType.simpleString()]
    block = F.pmod(F.xxhash64(*hashed, "_p"), F.lit(-(-most // BLOCK)))
    row = F.struct(*cols) if cols else F.struct(F.lit(True).alias(f"_{side}"))
    return pieces.groupBy(*ks, block.alias(f"_{side}b")).agg(F.flatten(F.collect_list(F.array_repeat(row, times))).alias(f"_{side}s"))


def expand(left: DataFrame, right: DataFrame, left_key: Keys, right_key: Keys, left_columns: Sequence[str], right_columns: Sequence[str] = (), made: int = MADE) -> DataFrame:
    """Inner join in which keys repeat on both sides. Each pair of blocks of a key is a row that any
    task can take, so that few keys, or few files, still keep all tasks busy; rows of the result
    are made last, from arrays. Costs an aggregate of each side's keys, which says how many they are;
    up to `made`, what one task makes, a plain join does."""
    lk, rk = keys_of(left_key), keys_of(right_key)
    a, b = _keyed(left, lk, left_columns, "l"), _keyed(right, rk, right_columns, "r")
    names = {"l": [f"_lk{i}" for i in range(len(lk))], "r": [f"_rk{i}" for i in range(len(rk))]}
    on = " AND ".join(f"{x} = {y}" for x, y in zip(names["l"], names["r"]))
    counts = [df.groupBy(*names[s]).agg(F.count("*").alias(f"_{s}n")) for df, s in ((a, "l"), (b, "r"))]
    most = counts[0].join(counts[1], F.expr(on), "full").agg(F.max("_ln"), F.max("_rn"), F.sum(F.col("_ln").cast("double") * F.col("_rn"))).first()
    if (most[2] or 0) <= made:
        return a.join(b, F.expr(on)).select(*(F.col(f"_l{i}").alias(c) for i, c in enumerate(left_columns)), *(F.col(f"_r{i}").alias(c) for i, c in enumerate(right_columns)))
    pairs = _blocks(a, len(lk), most[0], "l").join(_blocks(b, len(rk), most[1], "r"), F.expr(on))
    pairs = pairs.repartition(int(most[2] // max(made, 1)) + 1, *names["l"], "_lb", "_rb")
    one = len(right_columns) == 1  # an array of its values is read faster than one of rows
    out = pairs.select(F.inline("_ls"), (F.col("_rs")["_r0"] if one else F.col("_rs")).alias("_rs"))
    out = out.select(*(f"_l{i}" for i in range(len(left_columns))), F.explode("_rs").alias("_r0") if one else F.inline("_rs"))
    return out.select(*(F.col(f"_l{i}").alias(c) for i, c in enumerate(left_columns)), *(F.col(f"_r{i}").alias(c) for i, c in enumerate(right_columns)))


def _outer(left: DataFrame, right: DataFrame, left_key: Keys, right_key: Keys, left_columns: Sequence[str], right_columns: Sequence[str], unique: bool, zero_fill: bool) -> tuple[DataFrame, list[Column], list[Column], Column]:
    """The joined rows, and the columns of both sides and the mark of a match, to be selected."""
    lk, rk = keys_of(left_key), keys_of(right_key)
    if unique:
        check_unique(right, rk)
    r = _tagged(right, rk, right_columns)
    own = []
    for i, c in enumerate(right_columns):
        if c in rk:
            own.append(left[f"`{lk[rk.index(c)]}`"].alias(c))
        else:
            own.append((F.when(F.col("_hit"), F.col(f"_r{i}")).otherwise(zero_of(right.schema[c].dataType)) if zero_fill else F.col(f"_r{i}")).alias(c))
    return left.join(r, _on(left, lk), "left"), [left[f"`{c}`"] for c in left_columns], own, F.coalesce(F.col("_hit"), F.lit(False))


def left_join(left: DataFrame, right: DataFrame, left_key: Keys, right_key: Keys, left_columns: Sequence[str], right_columns: Sequence[str] = (), *, flag: str | None = None, unique: bool = True, zero_fill: bool = True) -> DataFrame:
    """All left rows; right columns of unmatched rows are zero (or null). Selecting a right key
    gives the left one. `flag` names a last column that tells whether the row matched."""
    both, a, b, hit = _outer(left, right, left_key, right_key, left_columns, right_columns, unique, zero_fill)
    return both.select(*a, *b, *([hit.alias(flag)] if flag else []))


def right_join(left: DataFrame, right: DataFrame, left_key: Keys, right_key: Keys, left_columns: Sequence[str], right_columns: Sequence[str], *, flag: str | None = None, unique: bool = True, zero_fill: bool = True) -> DataFrame:
    """All right rows: left_join with the sides exchanged, columns of the left first."""
    both, b, a, hit = _outer(right, left, right_key, left_key, right_columns, left_columns, unique, zero_fill)
    return both.select(*a, *b, *([hit.alias(flag)] if flag else []))


def intersect(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of the left's first column that the right's first column holds; repeated ones stay."""
    a, b = left.columns[0], right.columns[0]
    return semi(left.select(a), right, a, b)


def semi(left: DataFrame, right: DataFrame, left_key: Keys, right_key: Keys) -> DataFrame:
    r = _tagged(right, keys_of(right_key), ())
    return left.join(r, _on(left, keys_of(left_key)), "left_semi")


def anti(left: DataFrame, right: DataFrame, left_key: Keys, right_key: Keys) -> DataFrame:
    r = _tagged(right, keys_of(right_key), ())
    return left.join(r, _on(left, keys_of(left_key)), "left_anti")


def full_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, left_columns: Sequence[str], right_columns: Sequence[str], *, key: str = "key", unique: bool = True, zero_fill: bool = False) -> DataFrame:
    """All rows of both sides, matched where keys are equal: the key, the columns of both, in_left, in_right."""
    if unique:
        check_unique(left, left_key)
        check_unique(right, right_key)
    a = left.select(F.col(left_key).alias("_k"), *(F.col(c).alias(f"_l{i}") for i, c in enumerate(left_columns)), F.lit(True).alias("_left"))
    b = right.select(F.col(right_key).alias("_k"), *(F.col(c).alias(f"_r{i}") for i, c in enumerate(right_columns)), F.lit(True).alias("_right"))
    fill = lambda c, hit, kind: F.when(F.col(hit), F.col(c)).otherwise(zero_of(kind)) if zero_fill else F.col(c)
    return a.join(b, "_k", "full").select(
        F.col("_k").alias(key),
        *(fill(f"_l{i}", "_left", left.schema[c].dataType).alias(c) for i, c in enumerate(left_columns)),
        *(fill(f"_r{i}", "_right", right.schema[c].dataType).alias(c) for i, c in enumerate(right_columns)),
        F.coalesce("_left", F.lit(False)).alias("in_left"),
        F.coalesce("_right", F.lit(False)).alias("in_right"),
    )
