"""Problem 3: lines that stand in many documents of one dossier.

A line's key is its letters in one form and lower case, so that case, blanks,
invisible signs, punctuation and digits do not count. Keys that differ in one or
two misread letters make a class around a key of theirs, its centre; the lines
of a class have one identifier.

The suffix array decides which lines go: every suffix of the identifiers of a
text, all texts of all dossiers, sorted over the cluster by ranges. Suffixes that
follow each other with a common prefix hold the same block of lines; blocks that
span enough documents go. A block of one line is a repeated line; a longer block
never spans more documents than the rarest of its lines.

Centres are first the keys that stand unmisread in many documents; the keys that
these leave are then all taken as centres, against all keys of their dossier, so
a line of which no spelling is frequent is found too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.llm.lookalike import looks
from claimloom.sources.tables import small, written

KINDS = ("page", "paragraph")
CENTRE = 1 / 8  # share of the documents needed from which a key is a centre at once, not only in the second turn
SHORT = 64  # letters of a key that is carried along where pieces are joined
SPLIT = 20_000  # rows of one piece in one task
COUNTED, MORE = "etaons", "irlduc"  # letters whose counts are compared before the letters themselves; more of them in short keys
ONES = sum(1 << 5 * k for k in range(len(COUNTED + MORE)))  # the first bit of each lane of counts
FOUR, FIFTH, IS_SHORT = 15 * ONES, 16 * ONES, 1 << 62
OF_LONG = 16 * sum(1 << 5 * k for k in range(len(COUNTED)))
PAIRS = 1 << 17  # pairs of counts compared at a time
LETTERLESS = r"\p{P}\p{S}\p{N}\p{Zs}\p{Cf}"  # classes of signs that make or change no letter, alone or together
BLOCKS = "dossier bigint, block bigint, n_lines int, doc bigint, span_id string, line_no int"


def keyed_lines(spans: DataFrame) -> DataFrame:
    """dossier, doc, span_id, line_no, key: the lines of the ``text`` of ``spans``, and their letters in one form; "#" for lines of digits or signs only.

    Foreign signs that are no letters or marks (``LETTERLESS``) leave no letter in
    any form, so only lines with other foreign signs are brought to one form. The
    columns are made one after the other, as a column used twice is then made once.
    """
    lines = spans.select("dossier", "doc", "span_id", F.posexplode_outer(F.split("text", "\n")).alias("pos", "line"))
    lines = lines.withColumn("foreign", (F.octet_length("line") != F.length("line")) & F.col("line").rlike(rf"[^\p{{ASCII}}{LETTERLESS}]"))
    lines = lines.withColumn("form", looks(F.when(F.col("foreign"), F.col("line")), bare=True))
    letters = F.when(F.col("foreign"), F.regexp_replace(F.lower("form"), r"[^\p{L}]+", "")).otherwise(F.regexp_replace(F.lower("line"), "[^a-z]+", ""))
    shows = F.when(F.col("foreign"), F.col("form").rlike(r"\S")).otherwise(F.col("line").rlike(r"[^\s\p{Zs}\p{Cf}]"))
    key = F.when(F.col("letters") != "", F.col("letters")).when(shows, "#")
    return lines.withColumn("letters", letters).select("dossier", "doc", "span_id", (F.col("pos") + 1).alias("line_no"), key.alias("key"))


def _allowed(n: Column) -> Column:
    """Misread letters allowed in a key of ``n`` letters."""
    return F.when(n >= 6, 2).when(n >= 4, 1).otherwise(0)


def _code(n: Column) -> Column:
    """The size of a piece of keys of ``n`` letters, as a power of two up to n / 3, and the range of eight lengths."""
    size = F.floor(F.log2(F.greatest(n, F.lit(3)) / 3 + F.lit(1e-9)))
    return (F.floor(n / 8) * 64 + size).cast("int")


def _pieces(key: Column, code: Column, slack: int) -> Column:
    """Hashes, with the dossier and the code, of the first, second and last piece; the second also moved by up to ``slack``.

    Two misread letters leave one of three separate pieces whole: the first in
    its place, the last in its place from the end, or, with one slip before it,
    the second at most one place off.
    """
    p = F.col("size")
    cut = lambda tag, start: F.xxhash64("dossier", F.lit(tag), code, F.substring(key, start, p))
    places = [cut(1, p + 1 + s) for s in range(-slack, slack + 1)]
    return F.array(cut(0, F.lit(1)), *places, cut(2, -p))


def _sized(rows: DataFrame) -> DataFrame:
    return rows.withColumn("size", F.expr("shiftleft(1, code & 63)"))


def _own(rows: DataFrame, key: str, *columns: Column | str) -> DataFrame:
    """``columns`` of the ``rows`` with the three pieces of ``key`` and their places."""
    rows = _sized(rows.withColumn("code", _code(F.length(key))))
    return rows.select(*columns, F.posexplode(_pieces(F.col(key), F.col("code"), 0)).alias("place", "piece"))


def _offered(rows: DataFrame, *columns: Column | str) -> DataFrame:
    """``columns`` of the ``rows`` with each piece of their key that one of the pieces of any key near it equals.

    The codes are exploded first: exploding one array of all the pieces would be
    compiled into a method too large for the JVM to optimise.
    """
    codes = F.array_distinct(F.array(*[_code(F.length("key") + d) for d in (-2, 0, 2)]))
    rows = _sized(rows.withColumn("code", F.explode(codes)))
    return rows.select(*columns, F.explode(_pieces(F.col("key"), F.col("code"), 1)).alias("piece"))


def _counts(key: Column) -> Column:
    """How often each letter of ``COUNTED``, and in short keys of ``MORE``, stands in ``key``, modulo 16, in lanes of five bits; bit 62 is set for short keys."""

    def of(letters: str) -> Column:
        counts = F.lit(0).cast("bigint")
        for k, letter in enumerate(letters):
            n = F.octet_length(key) - F.octet_length(F.replace(key, F.lit(letter), F.lit("")))
            counts = counts.bitwiseOR(F.shiftleft(n.bitwiseAND(F.lit(15)).cast("bigint"), 5 * k))
        return counts

    return F.when(F.length(key) <= SHORT, of(COUNTED + MORE).bitwiseOR(F.lit(IS_SHORT))).otherwise(of(COUNTED))


def _may_be_near(counts: Column, other: Column) -> Column:
    """Whether no count differs by more than two and no more than four differ by an odd number, as two slips can make it.

    All lanes are compared at once: the fifth bit of each keeps them apart.
    """
    four, fifth, of_long, ones = map(F.lit, (FOUR, FIFTH, OF_LONG, ONES))
    moved = (counts.bitwiseAND(four).bitwiseOR(fifth) - other.bitwiseAND(four)).bitwiseAND(four)
    over = (moved + ones * 2).bitwiseAND(four) + ones * 11
    lanes = F.when(counts.bitwiseAND(other) >= F.lit(IS_SHORT), fifth).otherwise(of_long)
    odd = counts.bitwiseXOR(other).bitwiseAND(F.shiftright(lanes, 4))
    return (over.bitwiseAND(lanes) == F.lit(0)) & (F.bit_count(odd) <= 4)


def may_be_near(counts: np.ndarray, other: np.ndarray) -> np.ndarray:
    """As ``_may_be_near``, of two arrays of counts."""
    moved = (((counts & FOUR) | FIFTH) - (other & FOUR)) & FOUR
    over = ((moved + 2 * ONES) & FOUR) + 11 * ONES
    lanes = np.where((counts & other) >= IS_SHORT, FIFTH, OF_LONG)
    return ((over & lanes) == 0) & (np.bitwise_count((counts ^ other) & (lanes >> 4)) <= 4)


def _is_near(key: Column, centre: Column) -> Column:
    far = F.levenshtein(key, centre, 2)
    return (far >= 0) & (far <= _allowed(F.least(F.length(key), F.length(centre))))


def _near(lines: DataFrame, centres: DataFrame) -> DataFrame:
    """dossier, key_id, key, class_id, weight: keys with each other centre within the misread letters allowed.

    lines: dossier, key, key_id, counts; centres: dossier, class_id, centre, weight, counts.
    Only ids and counts are joined by a shuffle where the centres are too many
    to be broadcast; the letters of the few pairs left are fetched then.
    """
    n, c = F.length("key"), F.length("centre")
    ranges = centres.groupBy("dossier").agg(F.min(c).alias("least"), F.max(c).alias("most"))
    lines = lines.join(small(ranges), "dossier").where((n >= 4) & (n >= F.col("least") - 2) & (n <= F.col("most") + 2))
    asked = _own(centres.where(c >= 4), "centre", "dossier", "class_id", "centre", "weight", F.col("counts").alias("of_centre")).drop("place")
    few = small(asked)
    if few is not asked:
        offered = _offered(lines, "dossier", "key", "key_id", "counts")
        other = (F.col("key_id") != F.col("class_id")) & _may_be_near(F.col("counts"), F.col("of_centre"))
        near = offered.join(few.drop("dossier"), "piece").where(other & _is_near(F.col("key"), F.col("centre")))
        return near.select("dossier", "key_id", "key", "class_id", "weight").distinct()
    offered = _offered(lines, F.col("key_id").alias("id"), "counts", n.alias("m"), F.when(n <= SHORT, F.col("key")).alias("short")).distinct()
    asked = asked.select("piece", "dossier", "class_id", "weight", "of_centre", c.alias("n"), F.when(c <= SHORT, F.col("centre")).alias("short_centre"))
    pairs = _met(offered, asked).where("id <> class_id").select("dossier", F.col("id").alias("key_id"), "class_id", "weight").distinct()
    texts = lines.select("dossier", "key_id", "key").dropDuplicates(["dossier", "key_id"])
    pairs = pairs.join(texts, ["dossier", "key_id"]).join(centres.select("dossier", "class_id", "centre"), ["dossier", "class_id"])
    return pairs.where(_is_near(F.col("key"), F.col("centre"))).select("dossier", "key_id", "key", "class_id", "weight")


def _met(offered: DataFrame, asked: DataFrame) -> DataFrame:
    """dossier, class_id, weight, id: rows of both that share a piece, are alike in length and counts; pieces of many rows are split.

    offered: piece, m, counts, short, id; asked: piece, n, of_centre,
    short_centre, dossier, class_id, weight. Keys of up to ``SHORT`` letters are
    there as a whole and compared at once. A pair may occur under each piece.
    """
    hot = small(written(offered.groupBy("piece").agg(F.count("*").alias("rows")).where(F.col("rows") > SPLIT), "hot-pieces"))
    salts = F.coalesce(F.ceil(F.col("rows") / SPLIT), F.lit(1))
    asked = asked.join(hot, "piece", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), (salts - 1).cast("int")))).drop("rows")
    offered = offered.join(hot, "piece", "left").withColumn("salt", F.pmod(F.monotonically_increasing_id(), salts).cast("int")).drop("rows")
    asked = asked.withColumnsRenamed({"of_centre": "counts", "short_centre": "short"}).withColumn("is_offered", F.lit(False))
    offered = offered.withColumnRenamed("m", "n").withColumn("is_offered", F.lit(True))
    rows = asked.unionByName(offered, allowMissingColumns=True).repartition("piece", "salt").sortWithinPartitions("piece", "salt", "is_offered", "n")
    pairs = rows.mapInArrow(_pair_rows, "dossier bigint, class_id bigint, weight bigint, id bigint, short_centre string, short string")
    return pairs.where(F.coalesce(_is_near(F.col("short"), F.col("short_centre")), F.lit(True))).drop("short", "short_centre")


def _pair_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of the rows of ``_met``, which come in order. The rows of a piece and salt are held until its last one."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        cut = int(np.flatnonzero(_begins(batch))[-1])
        if cut or held and any(held[-1].column(c)[-1] != batch.column(c)[0] for c in ("piece", "salt")):
            yield from _pairs([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    yield from _pairs(held)


def _pairs(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of whole pieces. Only where both texts are there but not settled here do they come with the pair; others come once for each id."""
    for batch in pa.Table.from_batches(held).combine_chunks().to_batches() if held else []:
        n, counts, offered = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("n", "counts", "is_offered"))
        texts = batch.column("short").is_valid().to_numpy(zero_copy_only=False)
        letters, whole = _letters(batch.column("short"))
        ids = batch.column("id").dictionary_encode("encode").indices.to_numpy().astype(np.int64)
        for ai, oi in alike_pairs(np.cumsum(_begins(batch)), offered, n, counts):
            sure = whole[ai] & whole[oi] & (np.minimum(n[ai], n[oi]) >= 6)
            held = ~sure
            held[sure] = two_slips(letters[ai[sure]], n[ai[sure]], letters[oi[sure]], n[oi[sure]])
            ai, oi, sure = ai[held], oi[held], sure[held]
            both = texts[ai] & texts[oi] & ~sure
            once = np.unique(ai[~both] << 32 | ids[oi[~both]], return_index=True)[1]
            asks = pa.array(np.arange(both.sum() + len(once)) < both.sum())
            ai, oi = (pa.array(np.concatenate([x[both], x[~both][once]])) for x in (ai, oi))
            columns = [batch.column(c).take(ai) for c in ("dossier", "class_id", "weight")] + [batch.column("id").take(oi)]
            columns += [batch.column("short").take(pc.if_else(asks, i, None)) for i in (ai, oi)]
            yield pa.RecordBatch.from_arrays(columns, ["dossier", "class_id", "weight", "id", "short_centre", "short"])


def _letters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The letters of each of ``texts``, filled up with 0 to ``SHORT``, and which of them are of that many ASCII letters at most."""
    full = texts.cast(pa.string()).fill_null("")
    ends = np.frombuffer(full.buffers()[1], dtype=np.int32)[full.offset : full.offset + len(full) + 1].astype(np.int64)
    size, data = np.diff(ends), np.frombuffer(full.buffers()[2] or b"", dtype=np.uint8)
    whole = (size > 0) & (size <= SHORT)
    out = np.zeros((len(full), SHORT), dtype=np.uint8)
    held = np.arange(SHORT) < np.where(whole, size, 0)[:, None]
    rows, place = np.nonzero(held)
    out[held] = data[ends[rows] + place]
    return out, whole & (out < 128).all(1)


def two_slips(a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Whether rows of letters of ``a`` and ``b``, ``n_a`` and ``n_b`` of up to 64, become equal by two slips or fewer.

    For each number of slips and each shift of ``b`` against ``a``, the place in
    ``a`` that is reached at most; the bits of ``wrong`` are the places that differ.
    """
    wide = np.zeros((len(b), SHORT + 4), dtype=np.uint8)
    wide[:, 2 : SHORT + 2] = b
    wrong = {d: np.packbits(a != wide[:, 2 + d : 2 + d + SHORT], axis=1, bitorder="little").view(np.uint64).ravel() for d in range(-2, 3)}

    def on(d: int, at: np.ndarray) -> np.ndarray:
        ahead = wrong[d] >> at
        return np.minimum(at + np.bitwise_count((ahead & (~ahead + np.uint64(1))) - np.uint64(1)), np.uint64(SHORT))

    one = np.uint64(1)
    reached = {0: on(0, np.zeros(len(a), dtype=np.uint64))}
    for _ in range(2):
        last, reached = reached, {}
        for d in range(min(last) - 1, max(last) + 2):
            ways = [last[d + k] + step for k, step in ((1, one), (0, one), (-1, one - one)) if d + k in last]
            reached[d] = on(d, np.maximum.reduce(ways))
    shift = n_b.astype(np.int64) - n_a
    return np.choose(np.clip(shift, -2, 2) + 2, [reached[d] for d in range(-2, 3)]) >= n_a.astype(np.uint64)


def _begins(batch: pa.RecordBatch) -> np.ndarray:
    """Which rows are the first of their piece and salt."""
    out = np.ones(len(batch), dtype=bool)
    out[1:] = False
    for c in ("piece", "salt"):
        column = batch.column(c).to_numpy()
        out[1:] |= column[1:] != column[:-1]
    return out


def alike_pairs(groups: np.ndarray, offered: np.ndarray, n: np.ndarray, counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of asked and of ``offered`` rows of one group whose lengths ``n`` differ by two at most and whose ``counts`` may be near.

    The rows are in the order of groups, then asked ones first, then of lengths.
    All pairs of an asked row come together.
    """
    asked, given = np.flatnonzero(~offered), np.flatnonzero(offered)
    if not len(asked) or not len(given):
        return
    at = groups.astype(np.int64) * (int(n.max()) + 5) + n
    first = np.searchsorted(at[given], at[asked] - 2, "left")
    many = np.searchsorted(at[given], at[asked] + 2, "right") - first
    ends = np.cumsum(many)
    a = 0
    while a < len(asked):
        before = int(ends[a - 1]) if a else 0
        b = max(a + 1, int(np.searchsorted(ends, before + PAIRS, "right")))
        each = many[a:b]
        oi = given[np.arange(int(ends[b - 1]) - before) + np.repeat(first[a:b] - (ends[a:b] - each - before), each)]
        ai = np.repeat(asked[a:b], each)
        keep = may_be_near(counts[ai], counts[oi])
        if keep.any():
            yield ai[keep], oi[keep]
        a = b


def _rare_centres(keyed: DataFrame, gone: DataFrame, size: DataFrame) -> DataFrame:
    """dossier, class_id, centre, weight, counts: keys not ``gone`` around which enough documents may lie.

    Nothing is lost: a key near another holds one of the three pieces of it, so
    keys whose pieces stand in too few lines together are left out; so are those
    that share pieces, lengths and counts of letters with too few documents.
    Pieces of less than a third of the documents needed are not joined, but
    reckoned as just below it. A key ``gone`` counts as enough documents.
    """
    rest = keyed.where(F.length("key") >= 4).join(small(gone.select("dossier", "key_id")), ["dossier", "key_id"], "left_anti").join(size, "dossier")
    near = gone.where(F.length("key") >= 4).join(size, "dossier").withColumns({"counts": _counts(F.col("key")), "doc": F.lit(None).cast("bigint")})
    long, short = F.length("key"), F.when(F.length("key") <= SHORT, F.col("key"))
    every = rest.select("dossier", "key", "doc", "counts", "needed").unionByName(near.select("dossier", "key", "doc", "counts", "needed"))
    third = F.ceil(F.col("needed") / 3)
    hot = _offered(every, "doc", "needed").groupBy("piece").agg(F.sum(F.when(F.col("doc").isNull(), F.col("needed")).otherwise(1)).alias("of_piece"), F.max("needed").alias("needed"))
    hot = small(written(hot.where(F.col("of_piece") >= third).select("piece", "of_piece"), "frequent-pieces"), 1_000_000)
    own = _own(rest, "key", "dossier", "key_id", "counts", "needed", long.alias("n"), short.alias("short_centre")).join(hot, "piece")
    at = [F.max(F.when(F.col("place") == k, F.col(c))).alias(f"{c}{k}") for k in range(3) for c in ("piece", "of_piece")]
    own = own.groupBy("dossier", "key_id", "counts", "needed", "n", "short_centre").agg(*at)
    missed = third - 1
    own = own.where(sum(F.coalesce(F.col(f"of_piece{k}"), missed) for k in range(3)) >= F.col("needed"))
    own = written(own, "rare-keys")
    asked = own.select("dossier", F.col("key_id").alias("class_id"), F.lit(1).cast("bigint").alias("weight"), F.col("counts").alias("of_centre"), "n", "short_centre", F.explode(F.array_distinct(F.array_compact(F.array("piece0", "piece1", "piece2")))).alias("piece"))
    offered = _offered(every, F.col("doc").alias("id"), "counts", long.alias("m"), short.alias("short"))
    offered = written(offered.join(small(asked.select("piece").distinct(), 1_000_000), "piece"), "frequent-offers")
    docs = _met(offered, asked).select("dossier", "class_id", "id").distinct()
    docs = docs.groupBy("dossier", "class_id").agg(F.count("id").alias("docs"), F.bool_or(F.col("id").isNull()).alias("beside"))
    n_hot = sum(F.col(f"piece{k}").isNotNull().cast("int") for k in range(3))
    may = docs.join(own.select("dossier", F.col("key_id").alias("class_id"), "needed", n_hot.alias("n_hot")), ["dossier", "class_id"])
    may = may.where(F.col("beside") | (F.col("docs") + (3 - F.col("n_hot")) * missed >= F.col("needed")))
    may = small(written(may.select("dossier", F.col("class_id").alias("key_id")), "rare-centre-ids"))
    found = keyed.join(may, ["dossier", "key_id"]).groupBy("dossier", "key_id").agg(F.min("key").alias("centre"), F.min("counts").alias("counts"))
    return written(found.select("dossier", F.col("key_id").alias("class_id"), "centre", F.lit(1).cast("bigint").alias("weight"), "counts"), "rare-centres")


def suffixes(rows: np.ndarray, lines: np.ndarray, ids: np.ndarray, longest: int) -> np.ndarray:
    """For each identifier, itself and those of up to ``longest`` - 1 lines that follow it, else 0.

    rows: the text of each identifier; lines: its line. They are in order, with
    the identifiers of one line, the one it is known by first, side by side; a
    suffix may begin with any of them.
    """
    first = np.ones(len(ids), dtype=bool)
    first[1:] = (rows[1:] != rows[:-1]) | (lines[1:] != lines[:-1])
    at = np.flatnonzero(first)
    place = np.cumsum(first) - 1
    out = np.zeros((longest, len(ids)), dtype=np.int64)
    out[:1] = ids
    runs = np.ones(len(ids), dtype=bool)
    for k in range(1, longest):
        to = place + k
        runs &= to < len(at)
        there = at[np.minimum(to, len(at) - 1)]
        runs &= (rows[there] == rows) & (lines[there] == lines + k)
        out[k] = np.where(runs, ids[there], 0)
    return out


def common_prefixes(columns: np.ndarray) -> np.ndarray:
    """How many identifiers each sorted suffix shares with the one before it."""
    same = (columns[:, 1:] == columns[:, :-1]) & (columns[:, 1:] != 0)
    return np.concatenate([np.zeros(1, dtype=np.int64), np.logical_and.accumulate(same, 0).sum(0)])[: columns.shape[1]]


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = a.view(np.uint64), b.view(np.uint64)
    with np.errstate(over="ignore"):
        x = (a ^ (a >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + b
        return ((x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)).view(np.int64)


def _suffix_rows(longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("lines")
            rows = np.repeat(np.arange(len(batch)), np.diff(lists.offsets.to_numpy()))
            line, ids = (lists.flatten().field(k).to_numpy(zero_copy_only=False) for k in (0, 2))
            found = suffixes(rows, line, ids, longest)
            columns = [batch.column(c).take(pa.array(rows)) for c in ("dossier", "doc", "span_id")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(line, pa.int32()), *map(pa.array, found)], ["dossier", "doc", "span_id", "line_no", *_names(longest)])

    return run


def _names(longest: int) -> list[str]:
    return [f"id{k}" for k in range(longest)]


def _block_rows(longest: int):
    """Blocks of sorted suffixes. One that only a single suffix of a batch holds is left out, but at the ends of the batch, where it may go on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = np.array([batch.column(c).to_numpy() for c in _names(longest)])
            columns = columns.reshape(longest, len(batch))
            shared = common_prefixes(columns)
            name = columns[0]
            for k in range(longest):
                if k:
                    name = _mixed(name, columns[k])
                whole = columns[k] != 0
                if len(whole) == 0:
                    break
                meets = shared > k
                meets[0] = True
                meets = meets | np.append(meets[1:], True)
                at = np.flatnonzero(whole & meets)
                if len(at):
                    take = pa.array(at)
                    dossier, doc, span, line = (batch.column(c).take(take) for c in ("dossier", "doc", "span_id", "line_no"))
                    yield pa.RecordBatch.from_arrays([dossier, pa.array(name[at]), pa.array(np.full(len(at), k + 1, dtype=np.int32)), doc, span, line], ["dossier", "block", "n_lines", "doc", "span_id", "line_no"])

    return run


def blocks_of(met: DataFrame, size: DataFrame, longest: int) -> DataFrame:
    """dossier, block, n_lines, span_id, line_no: where a block of lines begins that spans enough documents.

    met: dossier, doc, span_id, line_no, class_id, weight of each line and class
    of it; size: dossier, needed. A block of one line is named by its class.
    Suffixes end after ``longest`` identifiers: a longer block is covered by
    shorter ones of as many documents.
    """
    each = F.array_sort(F.collect_list(F.struct("line_no", (-F.col("weight")).alias("least"), "class_id")))
    texts = met.groupBy("dossier", "doc", "span_id").agg(each.alias("lines"))
    names = _names(longest)
    schema = "dossier bigint, doc bigint, span_id string, line_no int, " + ", ".join(f"{c} bigint" for c in names)
    ordered = written(texts.mapInArrow(_suffix_rows(longest), schema), "suffixes")
    order = ["dossier", *names, "doc"]
    parts = int(ordered.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = ordered.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    found = written(ordered.mapInArrow(_block_rows(longest), BLOCKS), "blocks")
    spread = found.select("dossier", "block", "doc").distinct().groupBy("dossier", "block").agg(F.count("*").alias("docs"))
    go = written(spread.join(size, "dossier").where("docs >= needed").select("dossier", "block"), "frequent-blocks")
    return found.join(small(go), ["dossier", "block"], "left_semi").drop("doc")


def repeated_lines(
    spans: DataFrame, documents: DataFrame, share: float = 0.25, least: int = 5, shortest: int = 1, longest: int = 4
) -> DataFrame:
    """(span_id, line_no) of the lines to remove, counted from 1.

    spans: span_id, document_id, location_kind, text; only pages and paragraphs
    count. documents: document_id, dossier_id. A line goes if it stands within a
    block of ``shortest`` lines or more that at least ``share`` and at least
    ``least`` of those documents of its dossier hold that have such spans. Misread
    lines are counted with a line that stands unmisread in two documents or more,
    and in at least ``CENTRE`` of the documents needed; where that takes them
    nowhere, with any line.

    Null texts have no lines, but their document counts; blank lines never go;
    spans without a document or dossier give nothing, those without an id count
    but are not named; repeated rows count once;
    extra columns are ignored; empty tables give an empty result.
    """
    of = documents.select("document_id", F.xxhash64("dossier_id").alias("dossier")).where("dossier_id is not null").distinct()
    spans = spans.where(F.col("location_kind").isin(*KINDS)).select("span_id", "document_id", "text").join(small(of, 500_000), "document_id")
    spans = spans.select("dossier", F.xxhash64("document_id").alias("doc"), "span_id", "text")
    lines = written(keyed_lines(spans).withColumns({"key_id": F.xxhash64("key"), "counts": _counts(F.col("key"))}), "lines")

    size = lines.select("dossier", "doc").distinct().groupBy("dossier").agg(F.count("*").alias("of_docs"))
    size = size.select("dossier", F.greatest(F.lit(least), F.ceil(F.col("of_docs") * share)).alias("needed"))
    size = small(written(size, "dossiers"))
    keyed = lines.where("key is not null")
    unmisread = F.greatest(F.lit(2), F.ceil(F.col("needed") * CENTRE))
    rows = keyed.groupBy("dossier", "key_id").agg(F.count("*").alias("n_rows")).where("n_rows > 1")
    rows = rows.join(size, "dossier").where(F.col("n_rows") >= unmisread).select("dossier", "key_id")
    docs = keyed.join(small(written(rows, "line-keys")), ["dossier", "key_id"], "left_semi").groupBy("dossier", "key_id", "doc").agg(F.min("key").alias("key"), F.min("counts").alias("counts"))
    docs = docs.groupBy("dossier", "key_id").agg(F.count("*").alias("weight"), F.min("key").alias("centre"), F.min("counts").alias("counts"))
    docs = docs.join(size, "dossier").where(F.col("weight") >= unmisread)
    centres = written(docs.select("dossier", F.col("key_id").alias("class_id"), "centre", "weight", "counts"), "line-centres")

    found, gone = _turn(keyed, centres, size, longest, "frequent")
    rare = _rare_centres(keyed, gone, size)
    found = found.unionByName(_turn(keyed, rare, size, longest, "rare")[0]).where((F.col("n_lines") >= shortest) & F.col("span_id").isNotNull())
    return found.select("span_id", F.explode(F.expr("sequence(line_no, line_no + n_lines - 1)")).alias("line_no")).distinct()


def _turn(keyed: DataFrame, centres: DataFrame, size: DataFrame, longest: int, name: str) -> tuple[DataFrame, DataFrame]:
    """The blocks of lines in the classes around ``centres`` that span enough documents, and dossier, key_id, key of the keys in such classes."""
    itself = centres.select("dossier", F.col("class_id").alias("key_id"), F.col("centre").alias("key"), "class_id", "weight")
    other = keyed.join(small(itself.select("dossier", "key_id")), ["dossier", "key_id"], "left_anti").select("dossier", "key_id", "key", "counts")
    other = other.unionByName(centres.select("dossier", F.col("class_id").alias("key_id"), F.col("centre").alias("key"), "counts"))
    members = written(itself.unionByName(_near(other, centres)), f"{name}-members")
    met = keyed.join(small(members.drop("key")), ["dossier", "key_id"]).select("dossier", "doc", "span_id", "line_no", "class_id", "weight")
    found = blocks_of(met, size, longest)
    classes = found.where("n_lines = 1").select("dossier", F.col("block").alias("class_id")).distinct()
    gone = members.join(classes, ["dossier", "class_id"], "left_semi").groupBy("dossier", "key_id").agg(F.min("key").alias("key"))
    return found, written(gone, f"{name}-keys-gone")


def without_lines(spans: DataFrame, found: DataFrame) -> DataFrame:
    """``spans`` with the ``found`` (span_id, line_no) lines taken out of ``text``.

    A span that loses every line keeps "" as text; null texts stay null.
    """
    gone = found.groupBy("span_id").agg(F.collect_set("line_no").alias("gone_lines"))
    kept = F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains("gone_lines", i + 1))
    text = F.when(F.col("gone_lines").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return spans.join(gone, "span_id", "left").withColumn("text", text).drop("gone_lines")
