"""Order MinHash fingerprints, on built-in functions only.

A text is a sequence of words (runs of letters or digits, single ideographs, single other signs). Its k-mers are ``K``
words in a row; the n-th repeat of a k-mer in a text is an element of its own (occurrence numbering). Every element gets
one hash. ``TUPLES`` starting points lie evenly on the ring of hashes: from each, the ``L`` elements that come next are the
minimal ones under the hash turned to begin there. They are put back into text order and their tuple is hashed. Two texts
agree in a tuple only if they share its elements *and* have them in the same order, so likeness falls with edits and with
moved passages, where a plain MinHash does not see the latter. Every tuple has L elements, however short the text: where
few elements lie between two starting points, neighbouring tuples share some.

Likeness is the share of equal tuples; of two texts without words it is 1 if they are equal and else 0.

Cost: a text of n words is handled in its own row by two sorts of long arrays (one that numbers occurrences, one that
selects) and passes linear in n. Values are packed into longs (hash above, position below) so that sorting stays on
primitive arrays. Positions wrap beyond 2^27 words, hashes keep 36 bits: an equal pair within one text then shares a
numbering, which changes neither determinism nor equality.

A null text is an empty one, and an empty one has no tuples. Rows that repeat an id follow each other by a hash of their text;
rows without an id come last. Repeated rows are alike but for the last one's next text. An empty table gives no rows. Only the
id and the text are read, whatever other columns are called; :func:`with_fingerprint` replaces a column named as its result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import common

K = 3
L = 2
TUPLES = 32
WORD = r"[\p{L}\p{M}\p{N}&&[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}]]+|[^\s]"
_POS = 27
_ARC = 58  # of the 63 bits of a packed value, the upper five say after which starting point it lies (TUPLES = 2^5)


def _hashes(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w))


def with_fingerprint(df: DataFrame, text: str, out: str = "sketch") -> DataFrame:
    """Adds ``out``: an array of TUPLES longs, all null for a text without words. Null texts count as empty.

    Each step is a column of its own that the next uses more than once: the optimizer keeps them apart, so that a lambda
    reads a finished array instead of computing it again for each element.
    """
    names = ("words", "packed", "sorted", "firsts", "repeats", "runs", "elements", "least", "arcs")
    w, p, s, st, r, rs, e, b, arcs = (common.free_name(df, f"{out}_{x}", text, out) for x in names)
    mask = (1 << _POS) - 1
    element = lambda n: f"(shiftrightunsigned(xxhash64(x >> {_POS}, {n}), 28) << {_POS}) | (x & {mask}L)"
    return (
        df.withColumn(w, _hashes(common.text_or_empty(text)))
        # k-mer hash above, position below; a text shorter than K words has one k-mer
        .withColumn(p, F.expr(f"""transform(slice({w}, 1, if(size({w}) = 0, 0, greatest(size({w}) - {K - 1}, 1))), (x, i) ->
            (shiftrightunsigned(xxhash64({', '.join(f'get({w}, i + {j})' for j in range(K))}), 28) << {_POS}) | (i & {mask}L))"""))
        .withColumn(s, F.expr(f"if(size({p}) > 0, sort_array({p}), {p})"))
        # first occurrences, then repeats, which are few and still sorted by k-mer and position
        .withColumn(st, F.expr(f"filter({s}, (x, i) -> i = 0 or (x >> {_POS}) <> (get({s}, i - 1) >> {_POS}))"))
        .withColumn(r, F.expr(f"if(size({st}) = size({s}), slice({s}, 1, 0), filter({s}, (x, i) -> i > 0 and (x >> {_POS}) = (get({s}, i - 1) >> {_POS})))"))
        .withColumn(rs, F.expr(f"filter(transform({r}, (x, i) -> if(i = 0 or (x >> {_POS}) <> (get({r}, i - 1) >> {_POS}), i, -1)), i -> i >= 0)"))
        # element hash (of k-mer and occurrence number) above, position below
        .withColumn(e, F.expr(f"""concat(transform({st}, x -> {element('0')}),
            flatten(transform({rs}, (a, j) -> transform(slice({r}, a + 1, coalesce(get({rs}, j + 1), size({r})) - a), (x, n) -> {element('n + 1')}))))"""))
        .withColumn(e, F.expr(f"if(size({e}) > 0, sort_array({e}), {e})"))
        # no tuple reaches beyond the L least elements after each starting point: those whose L-th predecessor lies before it
        .withColumn(b, F.expr(f"filter({e}, (x, i) -> i < {L} or (x >> {_ARC}) <> (get({e}, i - {L}) >> {_ARC}))"))
        .withColumn(arcs, F.expr(f"transform({b}, x -> x >> {_ARC})"))
        .withColumn(b, F.expr(f"concat({b}, slice({b}, 1, {L}))"))  # the ring is closed
        .withColumn(out, F.expr(f"""transform(sequence(0L, {TUPLES - 1}L), n -> if(size({arcs}) = 0, cast(null as bigint),
            aggregate(sort_array(transform(slice({b}, size(filter({arcs}, a -> a < n)) + 1, least({L}, size({arcs}))), y -> ((y & {mask}L) << 36) | (shiftright(y, {_POS}) & 68719476735L))),
                0L, (h, y) -> xxhash64(h, y & 68719476735L))))"""))
        .drop(w, p, s, st, r, rs, e, b, arcs)
    )


def likeness(a: str, b: str, same_text: Column) -> Column:
    """Share of equal tuples; without any in either, 1 if the texts are equal and 0 if not."""
    empty = F.get(a, F.lit(0)).isNull() & F.get(b, F.lit(0)).isNull()
    equal = sum(F.coalesce((F.get(a, F.lit(i)) == F.get(b, F.lit(i))).cast("int"), F.lit(0)) for i in range(TUPLES))
    return F.when(empty, same_text.cast("double")).otherwise(equal / TUPLES)


def with_next(docs: DataFrame, ranges: int) -> DataFrame:
    """Adds ``_next`` (a struct of the text that follows in descending id order, the first one for the last) and the
    columns ``_range, _visitor, _key, _tie`` that place a row.

    Rows go to ranges of ids whose bounds are quantiles of the ids; an id (or its absence) that fills several ranges is
    divided among them by a hash of the text, which also orders rows of equal id. Each range also gets a copy (a visitor) of
    the first row of the one below, so that a window within the ranges sees every neighbour and a text is shuffled once.
    Visitors are still among the rows returned.
    """
    docs = docs.select(
        "doc_id", common.text_or_empty("text").alias("text"), F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).alias("_key")
    ).withColumn("_tie", F.xxhash64("text"))
    places = docs.select("_key", "_tie")
    probabilities = [i / ranges for i in range(1, ranges)]
    found = docs.select(F.col("_key").cast("double").alias("q")).approxQuantile("q", probabilities, 0.25 / ranges) if probabilities else []
    place = _place(_cuts(found))
    # the first row of each range: as many rows as ranges
    first = F.max(F.struct("_key", F.bitwise_not("_tie").alias("tie")))
    tops = {r["r"]: (r["top"][0], ~r["top"][1]) for r in places.groupBy(place.alias("r")).agg(first.alias("top")).collect()}
    full = sorted(tops)
    above = {r: full[i - 1] for i, r in enumerate(full)}  # the first range's top visits the last range
    every = range(full[-1] + 1 if full else 0)
    of_range = lambda values: F.get(_longs(values), F.col("_range"))
    top = F.struct(*[of_range([tops.get(r, (0, 0))[i] for r in every]).alias(name) for i, name in enumerate(("key", "tie"))], of_range([above.get(r, 0) for r in every]).cast("int").alias("above"))
    here = F.struct(F.col("_range"), F.lit(False).alias("_visitor"))
    is_top = (F.col("_top.key") == F.col("_key")) & (F.col("_top.tie") == F.col("_tie"))
    there = F.when(is_top, F.struct(F.col("_top.above").alias("_range"), F.lit(True).alias("_visitor"))) if full else F.lit(None).cast("struct<_range:int,_visitor:boolean>")
    rows = docs.withColumn("_range", place).withColumn("_top", top)
    rows = rows.select("doc_id", "text", "_key", "_tie", F.explode(F.array_compact(F.array(here, there))).alias("_at")).select("doc_id", "text", "_key", "_tie", "_at.*")
    return rows.withColumn("_next", F.lead("text").over(_order()))


def _order():
    return Window.partitionBy("_range").orderBy("_visitor", F.desc("_key"), "_tie")


def _cuts(quantiles: list[float]) -> list[tuple[int, int]]:
    """(id, text hash) after which a range ends, in the order of rows; an id that is several quantiles is cut by hash."""
    low, high = -(1 << 63), (1 << 63) - 1
    counts = Counter(max(low, min(high, int(q))) for q in quantiles)
    return [(key, high if i == n else low + (2**64 * i) // (n + 1)) for key, n in sorted(counts.items(), reverse=True) for i in range(1, n + 1)]


def _longs(values: Iterable[int]) -> Column:
    """An array of longs that the optimizer makes from one literal text: building it takes no call for each number."""
    text = ",".join(map(str, values))
    return F.split(F.lit(text), ",").cast("array<bigint>") if text else F.array().cast("array<bigint>")


def _place(cuts: list[tuple[int, int]]) -> Column:
    """How many cuts lie before the row, by a coarse and then a fine look."""
    if not cuts:
        return F.lit(0)
    step = max(1, int(len(cuts) ** 0.5))
    keys, ties = (_longs(c[i] for c in cuts) for i in (0, 1))
    before = lambda i: (F.get(keys, i) > F.col("_key")) | ((F.get(keys, i) == F.col("_key")) & (F.get(ties, i) < F.col("_tie")))
    passed = F.size(F.filter(_longs(range(step - 1, len(cuts), step)).cast("array<int>"), before)) * step
    fine = lambda p: p + F.size(F.filter(F.sequence(p, F.least(p + step, F.lit(len(cuts))) - 1), before))
    return F.get(F.transform(F.array(passed), lambda p: F.when(p < len(cuts), fine(p)).otherwise(p)), 0).cast("int")


def as_text(sketch: str) -> Column:
    """16 characters for each tuple: its value in hexadecimal, or dashes."""
    return F.array_join(F.transform(sketch, lambda x: F.coalesce(F.lpad(F.lower(F.hex(x)), 16, "0"), F.lit("-" * 16))), "")


def fingerprint_edits(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Fingerprints of each text, of its edited text and their likeness to each other and to the next document."""
    if ranges is None:
        ranges = min(4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 << 16)
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = (
        with_next(docs, ranges)
        .withColumn("n_chars", F.char_length("text").cast("long"))
        .withColumn("edited", F.when(F.col("_visitor"), F.lit("")).otherwise(F.concat(F.left("text", F.col("n_chars").cast("int") - half), F.left("_next", half))))
    )
    rows = with_fingerprint(with_fingerprint(rows, "text", "sketch"), "edited", "edited_sketch")
    rows = rows.select(
        "doc_id", "n_chars", "sketch", F.sha2("edited", 256).alias("edited_sha256"), as_text("edited_sketch").alias("edited_fingerprint"),
        likeness("sketch", "edited_sketch", F.col("text") == F.col("edited")).alias("near_edited"),
        F.xxhash64("text").alias("_hash"), "_range", "_visitor", "_key", "_tie",
    )
    after = lambda c: F.lead(c).over(_order())
    return (
        rows.withColumns({"_next_sketch": after("sketch"), "_next_hash": after("_hash")})
        .where(~F.col("_visitor"))
        .select(
            "doc_id", "n_chars", "edited_sha256", as_text("sketch").alias("fingerprint"), "edited_fingerprint", "near_edited",
            likeness("sketch", "_next_sketch", F.col("_hash") == F.col("_next_hash")).alias("near_next"),
        )
    )


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(common.table(spark, sf_dir, "documents"))
