"""Record linkage between a protected table and its original.

A protected record is at risk if exactly one original looks like it. Two records are
compared field by field; each field adds a similarity between 0 and 1, and a pair links
if the sum exceeds 1 and reaches ``min_score``. With a blocking column only records of
the same block are compared.

Blocks are skewed, and comparing all pairs of a block is quadratic in it. So:

1. Both sides are reduced to distinct rows with a weight. A block with few originals is
   compared directly: at most ``DIRECT_BLOCK`` comparisons per protected row and cover set, which
   costs less than what follows. All other blocks go on.
2. *Enough*: certain sets of agreeing fields are enough for a link whatever the others
   say. If two or more originals share such a set with a protected row, the row has more
   than one link and is settled by a count, without forming a pair. This is what happens
   to the rows of hot groups.
3. *Cover*: with ``q`` fields and room to lose ``k`` points, at most ``k`` fields can
   disagree completely, so every linked pair agrees on at least one set out of a fixed
   family. The remaining rows meet originals only under these keys, by one equi-join.
4. *Split*: the originals of every key are counted. A key with too many (``LOADED``) is split by
   fields that it does not use yet: those of its own set that it left out, then, where at most
   ``k`` of the other fields can disagree, ``k + 1`` groups of these, one of which has to agree. So
   keys grow longer where data are dense, and no key is made longer than it needs to be.
5. Each pair that meets is scored from the values themselves. A pair that meets under
   several keys is counted under the first key that it satisfies.

Both the sets and the count in step 2 are exact; nothing is sampled, capped or dropped.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.expressions import numeric_similarity, text_similarity
from veilspark.functions.relations import ratio, shuffled, staged
from veilspark.operators.equivalence import choose_block
from veilspark.operators.near_text import long_text_columns, near_text_pairs
from veilspark.operators.schema import align_types, column_class

# Blocks with more originals than this for each cover set are matched by keys instead of pair by pair.
DIRECT_BLOCK = 256
# Keys with more originals than this for each longer key that a row would have to look up are
# split by further fields: below that, looking up costs more than comparing.
LOADED = 6
# Families larger than this are replaced by a partition of the fields into groups, of
# which at least one has to agree.
MAX_KEY_SETS = 24
# Numeric fields of a key are matched by cells; a value probes the two cells that its
# partners can lie in. More fields than this are left to the comparison of the values.
MAX_NEAR_CELLS = 2
MAX_EQUAL_CELLS = 4
# Numbers this many cells away from zero are keyed by themselves: a cell would be narrower
# than what a double can tell apart, and counting cells would lose its precision.
MAX_CELL = 2.0**40
MAX_COUNTED = 2.0**50
# Scores are compared at nine decimals, so equal numbers may differ by a rounding error.
_EPS = 1e-9


@dataclass(frozen=True)
class Field:
    name: str
    numeric: bool
    scale: float = 1.0
    integer: bool = False
    tagged: bool = False  # a block of several datasets: value, zero character, dataset


@dataclass(frozen=True)
class KeySet:
    """Fields a pair has to agree on.

    ``slack`` is the loss the fields together may show: 0 asks for equality, ``None``
    for any similarity above zero.
    """

    fields: tuple[int, ...]
    slack: float | None


@dataclass(frozen=True)
class LinkageRule:
    """Which pairs link: field list, block, threshold and score mode."""

    fields: tuple[Field, ...]
    block: str | None
    min_score: float
    indexed: bool

    @property
    def compared(self) -> list[int]:
        """Positions of the fields other than the block."""
        return [i for i, f in enumerate(self.fields) if f.name != self.block]

    @property
    def room(self) -> float:
        """Points the compared fields may lose together before a pair fails.

        A sum of exactly 1 fails, which ``_EPS`` takes off the room where it matters.
        """
        base = 0.0 if self.block is None else 1.0
        total = len(self.compared) + base
        if self.indexed or self.min_score <= 1.0:
            return total - 1.0 - _EPS
        return total - float(self.min_score)

    @property
    def lost(self) -> int:
        """Compared fields that can disagree completely in a pair that links."""
        return min(math.floor(self.room), len(self.compared))

    @property
    def whole(self) -> bool:
        return abs(self.room - self.lost) < 1e-12

    @property
    def grouped(self) -> bool:
        """The cover is a partition of the fields into groups, as its sets would be too many."""
        n, kept = len(self.compared), len(self.compared) - self.lost
        return math.comb(n, kept) + (math.comb(n, kept + 1) if self.whole and self.lost else 0) > MAX_KEY_SETS

    def key_sets(self) -> tuple[list[KeySet], list[KeySet]]:
        """The families ``(enough, cover)`` described in the module text."""
        compared, room = self.compared, self.room
        if room < 0:
            return [], []
        lost, whole = self.lost, self.whole
        kept = len(compared) - lost
        subsets = lambda size: [c for c in combinations(compared, size)]
        if not self.grouped:
            exact = [KeySet(s, 0.0) for s in subsets(kept)]
            if not whole:
                enough = [KeySet(s, room - lost) for s in subsets(kept)]
                return exact + enough, [KeySet(s, None) for s in subsets(kept)]
            close = subsets(kept + 1) if lost else []
            return (
                exact + [KeySet(s, 1.0) for s in close],
                exact + [KeySet(s, None) for s in close],
            )
        groups = [tuple(compared[i :: lost + 1]) for i in range(lost + 1)]
        enough = [KeySet(tuple(compared), room)]
        for g in groups:
            if len(g) <= lost:
                enough.append(KeySet(tuple(c for c in compared if c not in g), room - len(g)))
        return enough, [KeySet(g, None) for g in groups]


    def extensions(self, s: KeySet) -> list[list[tuple[int, ...]]]:
        """Levels by which keys of a cover set are split; of each level one group has to agree.

        A pair that agrees on ``s`` also agrees on its fields beyond the ones in its key. Of the
        other fields at most ``lost`` disagree, so one of ``lost + 1`` groups agrees, however
        they are dealt: first in turn, then in runs.
        """
        limit = MAX_EQUAL_CELLS if s.slack == 0.0 else MAX_NEAR_CELLS
        numbers = [i for i in s.fields if self.fields[i].numeric]
        levels = [[(i,)] for i in numbers[limit:]]
        rest, k = [i for i in self.compared if i not in s.fields], self.lost + 1
        if self.grouped and len(rest) >= k:
            levels.append([tuple(rest[j::k]) for j in range(k)])
            levels.append([tuple(rest[j * len(rest) // k : (j + 1) * len(rest) // k]) for j in range(k)])
        return levels


def linkage_rule(
    protected: DataFrame,
    original: DataFrame,
    fields: Sequence[str],
    block: str | None,
    min_score: float | None = None,
    score: str = "similarity",
    indexer: str = "block",
    scale: dict[str, float] | None = None,
) -> LinkageRule:
    """Check the arguments and derive the rule.

    ``score='similarity'`` compares the sum of similarities with ``min_score``
    (``floor(0.7 * fields)`` by default). ``score='indexed'`` adds the 0-based row
    numbers of both records first, with ``int((fields + 3) * 0.7)`` as threshold.
    """
    if list(protected.columns) != list(original.columns):
        raise ValueError("variables of both tables do not match")
    if indexer not in ("block", "full"):
        raise ValueError("indexer has to be 'full' or 'block'")
    if indexer == "block" and not block:
        raise ValueError("empty block column")
    if score not in ("similarity", "indexed"):
        raise ValueError("score has to be 'similarity' or 'indexed'")
    missing = [f for f in fields if f not in protected.columns]
    if missing or (indexer == "block" and block not in fields):
        raise ValueError(f"unknown fields: {missing or [block]}")
    types = {f.name: column_class(f.dataType) for f in protected.schema}
    chosen = tuple(
        Field(f, types[f] in ("integer", "float"), (scale or {}).get(f, 1.0), types[f] == "integer")
        for f in fields
    )
    if min_score is None:
        n = len(chosen)
        min_score = int((n + 3) * 0.7) if score == "indexed" else math.floor(0.7 * n)
    return LinkageRule(
        chosen, block if indexer == "block" else None, float(min_score), score == "indexed"
    )


def _comparable(df: DataFrame, rule: LinkageRule, extra: Sequence[str] = ()) -> DataFrame:
    """Fields as ``f0, f1, ...``: whole numbers as bigint, others as doubles (NaN as null), the rest as text."""
    cols = []
    for i, f in enumerate(rule.fields):
        c = F.col(f.name)
        if f.integer:
            c = c.cast("bigint")
        elif f.numeric:
            c = c.cast("double")
            c = F.when(~F.isnan(c), c + F.lit(0.0))
        else:
            c = c.cast("string")
        cols.append(c.alias(f"f{i}"))
    return df.select(*cols, *extra)


def _with_position(df: DataFrame, id_cols: Sequence[str], top: int) -> DataFrame:
    """0-based row number by ``id_cols``, cut at ``top``.

    A row number of ``top`` or more lifts any pair over the threshold, so only the first
    ``top`` rows are numbered; they are found by a top-k, not by a global sort.
    """
    first = df.orderBy(*id_cols).limit(top).select(*id_cols).collect()
    position = F.lit(top)
    for i in reversed(range(len(first))):
        same = reduce(
            lambda a, b: a & b,
            [F.col(c).eqNullSafe(F.lit(v)) for c, v in zip(id_cols, first[i])],
        )
        position = F.when(same, i).otherwise(position)
    return df.withColumn("__position", position.cast("double"))


def _side(df: DataFrame, rule: LinkageRule, id_cols: Sequence[str]) -> DataFrame:
    """Distinct comparable rows with weight ``w`` and position ``p``."""
    if rule.indexed:
        if not id_cols:
            raise ValueError("score='indexed' needs id_cols for the row order")
        df = _with_position(df, id_cols, max(math.ceil(rule.min_score), 1))
        slim = _comparable(df, rule, [F.col("__position").alias("p")])
    else:
        slim = _comparable(df, rule, [F.lit(0.0).alias("p")])
    keys = [f"f{i}" for i in range(len(rule.fields))] + ["p"]
    return slim.groupBy(*keys).agg(F.count(F.lit(1)).alias("w"))


# The keys below are written as SQL text: they are long, and one parsed expression is
# much cheaper to build from Python than hundreds of column calls.


def _filled(rule: LinkageRule, i: int) -> str:
    """The field can agree with something: not null, not infinite, and not an empty text."""
    f = rule.fields[i]
    if f.integer:
        return f"f{i} IS NOT NULL"
    if f.numeric:
        return f"(f{i} > -double('infinity') AND f{i} < double('infinity'))"
    if f.tagged:
        return f"(f{i} IS NOT NULL AND NOT startswith(f{i}, char(0)))"
    return f"(f{i} IS NOT NULL AND f{i} <> '')"


def _block_position(rule: LinkageRule) -> int | None:
    names = [f.name for f in rule.fields]
    return None if rule.block is None else names.index(rule.block)


def _key(rule: LinkageRule, number: int, parts: Sequence[str]) -> str:
    """Join key: number of the key set, block, field values; all as text."""
    b = _block_position(rule)
    block = [] if b is None else [f"CAST(f{b} AS STRING)"]
    return f"array({', '.join([repr(str(number)), *block, *parts])})"


def _when_filled(rule: LinkageRule, s: KeySet, value: str) -> str:
    tests = [_filled(rule, i) for i in s.fields]
    return f"CASE WHEN {' AND '.join(tests)} THEN {value} END" if tests else value


def _enough_keys(rule: LinkageRule, sets: Sequence[KeySet]) -> Column:
    """Array of the keys under which a row can be settled by a count."""
    keys = []
    for n, s in enumerate(sets):
        numbers = [i for i in s.fields if rule.fields[i].numeric]
        parts = []
        for i in s.fields:
            value = f"f{i}"
            if rule.fields[i].numeric and s.slack:
                # Two values in one cell lose less than slack / len(numbers); the cell is a
                # little narrower than that, for the rounding of the division.
                cell = 0.999 * 2.0 * rule.fields[i].scale * s.slack / len(numbers)
                value = f"if({_countable(i, cell)}, concat('c', floor(f{i} / {cell!r}D)), concat('v', f{i}))"
            parts.append(f"CAST({value} AS STRING)")
        keys.append(_when_filled(rule, s, _key(rule, n, parts)))
    return F.expr(f"array_compact(array({', '.join(keys)}))")


def _countable(i: int, width: float) -> str:
    """Cells of this width can be counted exactly for the value."""
    return f"abs(CAST(f{i} AS DOUBLE)) < {min(MAX_CELL * width, MAX_CELL)!r}D"


def _cells(i: int, reach: float, width: float, left: bool, whole: bool) -> str:
    """Cells the partners of a value can lie in, or the one cell a value is filed under.

    With ``2 * reach <= width`` all values within ``reach`` lie in two or three neighbouring
    cells. Doubles too large to count cells exactly are filed by their single-precision
    rounding, which is coarser than ``reach`` there. Whole numbers never leave bigint.
    """
    f = f"f{i}"
    if whole:
        r, w = math.floor(reach), max(1, math.ceil(width))
        if not left:
            return f"array({f} div {w}L)"
        lowest, highest = "CAST('-9223372036854775808' AS BIGINT)", "9223372036854775807L"
        low = f"if({f} < {lowest} + {r}L, {lowest}, {f} - {r}L)"
        high = f"if({f} > {highest} - {r}L, {highest}, {f} + {r}L)"
        return f"array_distinct(array(({low}) div {w}L, ({high}) div {w}L))"
    most = MAX_COUNTED * width
    if not left:
        return f"array(if(abs({f}) < {most!r}D, floor({f} / {width!r}D), xxhash64(CAST({f} AS FLOAT))))"
    ends = [f"({f} {sign} {reach!r}D)" for sign in "-+"]
    cells = f"sequence({', '.join(f'floor({e} / {width!r}D)' for e in ends)})"
    both = [f"floor({e} / {width!r}D)" for e in (ends[0], f, ends[1])] + [f"xxhash64(CAST({e} AS FLOAT))" for e in ends]
    return f"if(abs({f}) < {most / 2!r}D, {cells}, array_distinct(array({', '.join(both)})))"


def _cover_keys(rule: LinkageRule, n: int, s: KeySet, left: bool) -> str:
    """Array of ``(n, key)`` under which a row is filed (original) or looked up.

    Keys are hashes: rows that share one by accident are told apart by their values.
    """
    b = _block_position(rule)
    parts, cells = [str(n)] + ([] if b is None else [f"f{b}"]), []
    limit = MAX_EQUAL_CELLS if s.slack == 0.0 else MAX_NEAR_CELLS
    for i in s.fields:
        f = rule.fields[i]
        if not f.numeric:
            parts.append(f"f{i}")
        elif len(cells) < limit:
            reach, width = (1e-8, 1e-6) if s.slack == 0.0 else (2.0, 4.0)
            cells.append(_cells(i, reach * f.scale, width * f.scale, left, f.integer))
    keys = f"array(xxhash64({', '.join(parts)}))"
    for c in cells:
        # Every key extended by every cell.
        keys = f"flatten(transform({keys}, k -> transform({c}, c -> xxhash64(k, c))))"
    keys = f"array_distinct({keys})" if cells and left else keys
    return _when_filled(rule, s, f"transform({keys}, k -> struct({n} AS n, k AS key))")


def _cover_rows(
    df: DataFrame,
    rule: LinkageRule,
    sets: Sequence[KeySet],
    carried: Sequence[str],
    left: bool,
    near: dict[int, DataFrame],
) -> DataFrame:
    """Rows repeated once per cover key, as ``(n, key, fields, carried)``.

    The protected side probes neighbouring cells and the similar values of long texts;
    the original side files each row once per key set.
    """
    values = [f"f{i}" for i in range(len(rule.fields))]
    # Key sets that use the same long texts share one expansion of the rows.
    by_texts: dict[tuple[int, ...], list[str]] = {}
    for n, s in enumerate(sets):
        texts = tuple(i for i in s.fields if left and i in near)
        by_texts.setdefault(texts, []).append(_cover_keys(rule, n, s, left))

    frames = []
    for texts, keys in by_texts.items():
        rows, own = df, {}
        for i in texts:
            # Replace the value by itself and by each similar value in turn.
            own[i] = f"own_{i}"
            kept = rows.withColumn(own[i], F.col(f"f{i}"))
            same = F.col(own[i]) == F.col("lv")
            if "block" in near[i].columns:
                same = same & (F.col(f"f{_block_position(rule)}") == F.col("block"))
            others = kept.join(shuffled(near[i]), same)
            others = others.withColumn(f"f{i}", F.col("rv")).drop("lv", "rv", "block")
            rows = kept.unionByName(others)
        filed = F.explode(F.expr(f"flatten(array_compact(array({', '.join(keys)})))"))
        restored = [F.col(own.get(i, v)).alias(v) for i, v in enumerate(values)]
        frames.append(
            rows.select(filed.alias("x"), *restored, *carried).select("x.n", "x.key", *values, *carried)
        )
    return reduce(DataFrame.unionByName, frames)


def _sided(df: DataFrame, rule: LinkageRule, side: str, carried: Sequence[str], *keep: str) -> DataFrame:
    names = [*[f"f{i}" for i in range(len(rule.fields))], *carried]
    return df.select(*keep, *[F.col(c).alias(f"{side}_{c}") for c in names])


def _reachable(rule: LinkageRule) -> Column:
    """The similarities can still add up to a link; texts of ten bytes and more count as similar.

    Short enough to be compiled into the join, so most pairs that meet are dropped before a
    row is made of them.
    """
    b, parts = _block_position(rule), []
    for i, f in enumerate(rule.fields):
        left, right = f"l_f{i}", f"r_f{i}"
        if i == b:
            parts.append("1D")
        elif f.numeric:
            apart = f"CAST(try_subtract({left}, {right}) AS DOUBLE)" if f.integer else f"({left} - {right})"
            parts.append(f"coalesce(greatest(0D, 1D - abs({apart}) / {2.0 * f.scale!r}D), 0D)")
        else:
            parts.append(f"if({left} = {right} OR octet_length({left}) >= 10 OR octet_length({right}) >= 10, 1D, 0D)")
    return F.expr(f"{' + '.join(parts)} >= {_needed(rule) - _EPS!r}D")


def _needed(rule: LinkageRule) -> float:
    """Sum of similarities below which no pair links."""
    return 1.0 if rule.indexed else max(rule.min_score, 1.0)


def _similarities(rule: LinkageRule) -> list[Column]:
    """Similarity of every field of a met pair.

    The edit distance is computed only where it can still lift the pair to the threshold;
    elsewhere the pair fails whatever it is, and 0 stands for it.
    """
    b = _block_position(rule)
    cheap, sims = {}, []
    for i, f in enumerate(rule.fields):
        if i == b:
            # Equal by the join; an empty text agrees with nothing.
            cheap[i] = F.lit(1.0) if f.numeric else F.expr(f"CASE WHEN {_filled(rule, i).replace(f'f{i}', f'l_f{i}')} THEN 1D ELSE 0D END")
        elif f.numeric:
            cheap[i] = numeric_similarity(F.col(f"l_f{i}"), F.col(f"r_f{i}"), f.scale, f.integer)
    texts = [i for i in range(len(rule.fields)) if i not in cheap]
    bounds = [
        F.expr(f"CASE WHEN l_f{i} = r_f{i} OR greatest(length(l_f{i}), length(r_f{i})) >= 10 THEN 1D ELSE 0D END")
        for i in texts
    ]
    reachable = reduce(lambda x, y: x + y, [*cheap.values(), *bounds])
    worth = reachable >= F.lit(_needed(rule) - _EPS)
    for i in range(len(rule.fields)):
        sims.append(
            cheap[i] if i in cheap else text_similarity(F.col(f"l_f{i}"), F.col(f"r_f{i}"), worth=worth)
        )
    return [c.alias(f"s{i}") for i, c in enumerate(sims)]


def _scored(met: DataFrame, rule: LinkageRule) -> DataFrame:
    """Pairs with their similarities ``s0, s1, ...``.

    They are generated, not projected: what is asked of them then stays out of the join's condition,
    which would become too long to be compiled.
    """
    return met.select("*", F.inline(F.array(F.struct(*_similarities(rule)))))


def _linked(met: DataFrame, rule: LinkageRule) -> DataFrame:
    """Scored pairs that link, of pairs with their similarities ``s0, s1, ...``."""
    total = F.expr(f"round({' + '.join(f's{i}' for i in range(len(rule.fields)))}, 9)")
    position = F.col("l_p") + F.col("r_p") if rule.indexed else F.lit(0.0)
    scored = met.withColumn("similarity", total).withColumn("score", F.col("similarity") + position)
    return scored.where((F.col("similarity") > 1) & (F.col("score") >= F.lit(float(rule.min_score))))


def _pairs_by_block(
    left: DataFrame, right: DataFrame, rule: LinkageRule, left_cols: Sequence[str], right_cols: Sequence[str]
) -> DataFrame:
    """Linked pairs of small blocks: all pairs of a block are compared."""
    b = _block_position(rule)
    a, o = _sided(left, rule, "l", left_cols), _sided(right, rule, "r", right_cols)
    met = a.join(shuffled(o), (F.col(f"l_f{b}") == F.col(f"r_f{b}")) & _reachable(rule))
    return _linked(_scored(met, rule), rule)


def _group_keys(rule: LinkageRule, group: Sequence[int], equal: bool, left: bool, near: Sequence[int]) -> str:
    """Array of hashes of a group of fields, several where numbers may lie in neighbouring cells.

    Texts with similar partners are left out: agreement on the others is necessary, too.
    """
    texts = [i for i in group if not rule.fields[i].numeric and i not in near]
    numbers = [i for i in group if rule.fields[i].numeric][: MAX_EQUAL_CELLS if equal else MAX_NEAR_CELLS]
    keys = f"array(xxhash64({', '.join(['0', *[f'f{i}' for i in texts]])}))"
    for i in numbers:
        f, (reach, width) = rule.fields[i], (1e-8, 1e-6) if equal else (2.0, 4.0)
        cells = _cells(i, reach * f.scale, width * f.scale, left, f.integer)
        keys = f"flatten(transform({keys}, k -> transform({cells}, c -> xxhash64(k, c))))"
    tests = [_filled(rule, i) for i in group]
    return f"CASE WHEN {' AND '.join(tests)} THEN {f'array_distinct({keys})' if left else keys} ELSE array() END"


def _lookups(rule: LinkageRule, groups: Sequence[Sequence[int]]) -> int:
    """Keys that a protected row looks up in place of one that is split; a number may lie in three cells."""
    return sum(3 ** min(sum(rule.fields[i].numeric for i in g), MAX_NEAR_CELLS) for g in groups)


def _split_keys(rule: LinkageRule, cover: Sequence[KeySet], level: int, left: bool, near: Sequence[int]) -> Column:
    """``(x, key)`` in place of a loaded key: group and longer key. Sets without such a level keep theirs."""
    cases = []
    for n, s in enumerate(cover):
        levels = rule.extensions(s)
        if level < len(levels):
            groups = [
                f"transform({_group_keys(rule, g, s.slack == 0.0 and g[0] in s.fields, left, near)}, h -> struct({x} AS x, xxhash64(key, {x}, h) AS key))"
                for x, g in enumerate(levels[level])
                if g
            ]
            cases.append(f"WHEN {n} THEN {groups[0] if len(groups) == 1 else f'concat({chr(44).join(groups)})'}")
    own = "array(struct(CAST(NULL AS INT) AS x, key AS key))"
    return F.expr(f"CASE WHEN loaded IS NULL THEN {own} ELSE CASE n {' '.join(cases)} ELSE {own} END END")


def _keyed_sides(
    left: DataFrame, right: DataFrame, rule: LinkageRule, cover: Sequence[KeySet],
    left_cols: Sequence[str], right_cols: Sequence[str], near: dict[int, DataFrame],
) -> tuple[DataFrame, DataFrame, int]:
    """Both sides by cover key, loaded keys split; the number of levels gives the columns ``x0, x1, ...``."""
    a = _cover_rows(left, rule, cover, left_cols, True, near)
    o = _cover_rows(right, rule, cover, right_cols, False, {})
    depth = max(len(rule.extensions(s)) for s in cover)
    for level in range(depth):
        splits = [n for n, s in enumerate(cover) if level < len(rule.extensions(s))]
        most = F.lit(None).cast("int")
        for n in splits:
            most = F.when(F.col("n") == n, LOADED * _lookups(rule, rule.extensions(cover[n])[level])).otherwise(most)
        counts = o.where(F.col("n").isin(splits)).groupBy("n", "key").agg(F.count(F.lit(1)).alias("loaded"))
        loaded = staged(counts.where(F.col("loaded") > most).select("key", "loaded").distinct(), "loaded-keys")
        if loaded.isEmpty():
            return a, o, level

        def split(side: DataFrame, of_left: bool) -> DataFrame:
            rest = [c for c in side.columns if c != "key"]
            met = side.join(loaded, "key", "left").withColumn("y", F.explode(_split_keys(rule, cover, level, of_left, list(near))))
            return met.select(*rest, "y.key", *([F.col("y.x").alias(f"x{level}")] if of_left else []))

        a, o = split(a, True), staged(split(o, False), "split-keys")
    return a, o, depth


def _pairs_by_keys(
    left: DataFrame, right: DataFrame, rule: LinkageRule, cover: Sequence[KeySet],
    left_cols: Sequence[str], right_cols: Sequence[str], near: dict[int, DataFrame],
) -> DataFrame:
    """Linked pairs that meet under a cover key, each once."""
    b = _block_position(rule)
    if b is not None:
        left, right = (d.where(F.col(f"f{b}").isNotNull()) for d in (left, right))
    a, o, levels = _keyed_sides(left, right, rule, cover, left_cols, right_cols, near)
    marks = [f"x{i}" for i in range(levels)]
    a, o = _sided(a, rule, "l", left_cols, "n", "key", *marks), _sided(o, rule, "r", right_cols, F.col("key").alias("r_key"))
    same = F.col("key") == F.col("r_key")
    if b is not None:
        same = same & (F.col(f"l_f{b}") == F.col(f"r_f{b}"))
    scored = _scored(a.join(shuffled(o), same & _reachable(rule)), rule)

    def satisfied(fields: Sequence[int], equal: bool = False) -> str:
        return " AND ".join(f"s{i} > {1.0 - _EPS if equal and rule.fields[i].numeric else 0.0!r}D" for i in fields)

    first = F.expr(f"CASE {' '.join(f'WHEN {satisfied(s.fields, s.slack == 0.0)} THEN {n}' for n, s in enumerate(cover))} END")
    scored = scored.where(F.col("n") == first)
    for level in range(levels):
        # Of several groups that agree, the first one counts the pair.
        cases = []
        for n, s in enumerate(cover):
            groups = [(x, g) for x, g in enumerate(rule.extensions(s)[level]) if g] if level < len(rule.extensions(s)) else []
            if len(groups) > 1:
                cases.append(f"WHEN {n} THEN CASE {' '.join(f'WHEN {satisfied(g)} THEN {x}' for x, g in groups)} END")
        if cases:
            scored = scored.where(F.col(f"x{level}").isNull() | F.expr(f"x{level} <=> CASE n {' '.join(cases)} ELSE x{level} END"))
    return _linked(scored, rule)


def _crowded_blocks(right: DataFrame, rule: LinkageRule) -> tuple[bool, bool, DataFrame | None]:
    """Are there small blocks, are there large ones, and which are the large ones?"""
    b = _block_position(rule)
    if b is None:
        return False, True, None
    limit = DIRECT_BLOCK * max(1, len(rule.key_sets()[1]))
    sizes = right.select(f"f{b}").groupBy(f"f{b}").agg(F.count(F.lit(1)).alias("n"))
    small = F.count_if(F.col("n") <= limit).alias("small")
    large = F.count_if(F.col("n") > limit).alias("large")
    row = sizes.where(F.col(f"f{b}").isNotNull()).agg(small, large).first()
    return row["small"] > 0, row["large"] > 0, sizes.where(F.col("n") > limit).select(f"f{b}")


def _all_pairs(
    left: DataFrame, right: DataFrame, rule: LinkageRule, blocks: tuple, near: dict[int, DataFrame],
    left_cols: Sequence[str], right_cols: Sequence[str], settle: bool,
) -> DataFrame:
    """Linked pairs of all blocks; with ``settle`` rows that a count settles are left out."""
    enough, cover = rule.key_sets()
    small, large, which = blocks
    if not large:
        return _pairs_by_block(left, right, rule, left_cols, right_cols)
    found = []
    if small:
        on = which.columns
        found.append(
            _pairs_by_block(
                left.join(which, on, "left_anti"), right.join(which, on, "left_anti"), rule, left_cols, right_cols
            )
        )
        left, right = left.join(which, on, "left_semi"), right.join(which, on, "left_semi")
    rest = unresolved_rows(left, right, rule, enough) if settle else left
    keyed = _pairs_by_keys(rest, right, rule, cover, left_cols, right_cols, near)
    found.append(keyed.select(*found[0].columns) if found else keyed)
    return reduce(DataFrame.unionByName, found)


def _near_tables(
    left: DataFrame, right: DataFrame, rule: LinkageRule, cover: Sequence[KeySet]
) -> dict[int, DataFrame]:
    """Similar but unequal values, within a block, of the long text fields that occur in keys."""
    b = _block_position(rule)
    block = [] if b is None else [f"f{b}"]
    if block:
        left, right = (side.where(F.col(block[0]).isNotNull()) for side in (left, right))
    used = {i for s in cover for i in s.fields if not rule.fields[i].numeric}
    long = long_text_columns(left, right, [f"f{i}" for i in sorted(used)])
    found = {}
    for c, longest in long.items():
        values = [side.select(c, *block).distinct() for side in (left, right)]
        # Several key sets join this table, so it is written once.
        pairs = staged(near_text_pairs(*values, c, longest, *block), "near")
        if not pairs.isEmpty():
            found[int(c[1:])] = pairs
    return found


def unresolved_rows(
    left: DataFrame, right: DataFrame, rule: LinkageRule, enough: Sequence[KeySet]
) -> DataFrame:
    """Protected rows that no count has shown to have more than one link."""
    if not enough:
        return left
    b = _block_position(rule)
    filed = right if b is None else right.where(_filled(rule, b))
    if rule.indexed:
        # Any original past the numbered ones passes the threshold on its own.
        filed = filed.where(F.col("p") >= float(math.ceil(rule.min_score)))
    crowded = (
        filed.select(F.explode(_enough_keys(rule, enough)).alias("key"), "w")
        .groupBy("key")
        .agg(F.sum("w").alias("n"))
        .where(F.col("n") > 1)
        .select("key")
    )
    keys = [f"f{i}" for i in range(len(rule.fields))] + ["p", "w"]
    settled = (
        left.select(*keys, F.explode(_enough_keys(rule, enough)).alias("key"))
        .join(shuffled(crowded), "key", "left_semi")
        .select(*keys)
        .distinct()
    )
    on = [left[k].eqNullSafe(settled[k]) for k in keys[:-1]]
    return left.join(shuffled(settled), on, "left_anti")


def _alone(left: DataFrame, right: DataFrame, rule: LinkageRule, blocks: tuple, near: dict[int, DataFrame]) -> DataFrame:
    """Distinct protected rows that link to exactly one original, with their weight ``l_w``."""
    pairs = _all_pairs(left, right, rule, blocks, near, ["p", "w"], ["p", "w"], True)
    keys = [f"l_f{i}" for i in range(len(rule.fields))] + ["l_p", "l_w"]
    return pairs.groupBy(*keys).agg(F.sum("r_w").alias("links")).where(F.col("links") == 1)


def tagged_links(protected: DataFrame, original: DataFrame, rule: LinkageRule) -> DataFrame:
    """``(tag, n)``: how many protected rows of each tag link to exactly one original.

    ``protected`` holds several versions of a table under the column ``tag``. Rows that are
    equal in several versions are compared once, for all their tags; the original is filed once.
    """
    _, cover = rule.key_sets()
    plain = _comparable(protected, rule, ["tag"]), _comparable(original, rule)
    values = [f"f{i}" for i in range(len(rule.fields))]
    if not cover:
        return plain[0].groupBy("tag").agg(F.lit(0).cast("bigint").alias("n"))
    blocks = _crowded_blocks(plain[1], rule)
    near = _near_tables(*plain, rule, cover) if blocks[1] else {}
    each = plain[0].groupBy(*values, "tag").agg(F.count(F.lit(1)).alias("w"))
    left = each.groupBy(*values).agg(F.sort_array(F.collect_list(F.struct("tag", "w"))).alias("w"))
    alone = _alone(left.withColumn("p", F.lit(0.0)), _side(original, rule, ()), rule, blocks, near)
    return alone.select(F.explode("l_w").alias("x")).groupBy("x.tag").agg(F.sum("x.w").alias("n"))


def linkage_risk(
    protected: DataFrame,
    original: DataFrame,
    fields: Sequence[str],
    block: str | None = None,
    min_score: float | None = None,
    score: str = "similarity",
    indexer: str = "block",
    id_cols: Sequence[str] = (),
    scale: dict[str, float] | None = None,
    name: str = "rl",
) -> DataFrame:
    """``rl``: percentage of protected records that link to exactly one original.

    One row; null for an empty table.
    """
    rule, left, right = _prepare(
        protected, original, fields, block, min_score, score, indexer, id_cols, scale
    )
    total = protected.agg(F.count(F.lit(1)).alias("n"))
    _, cover = rule.key_sets()
    if not cover:
        return total.select(F.when(F.col("n") > 0, 0.0).alias(name))
    plain = _comparable(left, rule), _comparable(right, rule)
    blocks = _crowded_blocks(plain[1], rule)
    near = _near_tables(*plain, rule, cover) if blocks[1] else {}
    single = _alone(_side(left, rule, id_cols), _side(right, rule, id_cols), rule, blocks, near)
    single = single.agg(F.coalesce(F.sum("l_w"), F.lit(0)).alias("at_risk"))
    # Two one-row aggregates side by side.
    both = single.select("at_risk", F.lit(None).cast("bigint").alias("n")).unionByName(
        total.select(F.lit(None).cast("bigint").alias("at_risk"), "n")
    )
    return both.agg(ratio(100 * F.max("at_risk"), F.max("n")).alias(name))


def linked_pairs(
    protected: DataFrame,
    original: DataFrame,
    fields: Sequence[str],
    id_cols: Sequence[str],
    block: str | None = None,
    min_score: float | None = None,
    score: str = "similarity",
    indexer: str = "block",
    scale: dict[str, float] | None = None,
) -> DataFrame:
    """All linked pairs: ids of both records, similarity and score."""
    rule, left, right = _prepare(
        protected, original, fields, block, min_score, score, indexer, id_cols, scale
    )
    _, cover = rule.key_sets()
    ids = [f"id{i}" for i in range(len(id_cols))]
    named = [F.col(c).alias(n) for c, n in zip(id_cols, ids)]
    top = max(math.ceil(rule.min_score), 1)
    def rows(df: DataFrame) -> DataFrame:
        if rule.indexed:
            df = _with_position(df, id_cols, top)
        position = F.col("__position") if rule.indexed else F.lit(0.0)
        return _comparable(df, rule, [*named, position.alias("p")])

    left, right = rows(left), rows(right)
    if not cover:
        # No pair can reach the threshold.
        left, blocks, near = left.limit(0), (True, False, None), {}
        block = block or fields[0]
        rule = linkage_rule(protected, original, fields, block, min_score, score, "block", scale)
    else:
        blocks = None
    # Rows that are equal in all fields have the same pairs: one of them is compared, then all are named.
    (a, left), (o, right) = _classes(left, rule, "protected"), _classes(right, rule, "original")
    if blocks is None:
        blocks = _crowded_blocks(o, rule)
        near = _near_tables(a, o, rule, cover) if blocks[1] else {}
    pairs = _all_pairs(a, o, rule, blocks, near, ["class", "p"], ["class", "p"], False)
    pairs = pairs.select("l_class", "r_class", "similarity", "score")
    for side, members in (("l", left), ("r", right)):
        named = members.select(F.col("class").alias(f"{side}_class"), *[F.col(i).alias(f"{side}_{i}") for i in ids])
        pairs = pairs.join(shuffled(named), f"{side}_class")
    return pairs.select(
        *[F.col(f"l_{i}").alias(f"{c}_protected") for i, c in zip(ids, id_cols)],
        *[F.col(f"r_{i}").alias(f"{c}_original") for i, c in zip(ids, id_cols)],
        "similarity",
        "score",
    )


def _classes(rows: DataFrame, rule: LinkageRule, label: str) -> tuple[DataFrame, DataFrame]:
    """Distinct comparable rows numbered as ``class``, and all rows with the number of theirs.

    The numbers depend on partitioning, so they are written once and read back.
    """
    values = [*[f"f{i}" for i in range(len(rule.fields))], "p"]
    classes = staged(rows.select(*values).distinct().withColumn("class", F.monotonically_increasing_id()), f"classes-{label}")
    named = classes.select(*[F.col(v).alias(f"own_{v}") for v in values], "class")
    same = [F.col(v).eqNullSafe(F.col(f"own_{v}")) for v in values]
    return classes, rows.join(shuffled(named), same).drop(*named.columns[:-1])


def _prepare(protected, original, fields, block, min_score, score, indexer, id_cols, scale):
    keep = [*[c for c in id_cols if c not in fields], *fields]
    left, right = protected.select(*keep), original.select(*keep)
    rule = linkage_rule(left, right, fields, block, min_score, score, indexer, scale)
    return rule, left, align_types(right, left)


def rl_value(
    protected: DataFrame,
    original: DataFrame,
    fields: Sequence[str],
    min_score: float | None = None,
    score: str = "similarity",
    id_cols: Sequence[str] = (),
    scale: dict[str, float] | None = None,
    approximate: bool = False,
) -> tuple[float | None, str]:
    """``(rl, blocking column)`` with the block chosen from the protected table.

    A one-valued block singles nobody out: the risk is 0 and nothing is compared.
    ``approximate`` counts distinct values by sketch when choosing the block, which
    spares very wide or very long tables a shuffle per column.
    """
    block, stats = choose_block(protected, fields, approximate)
    if stats.distinct[block] == 1:
        return 0.0, block
    found = linkage_risk(
        protected, original, fields, block, min_score, score, "block", id_cols, scale
    )
    return found.first()[0], block
