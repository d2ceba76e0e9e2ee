"""Personal data spans by weak supervision, on built-in functions only.

Candidates are the strict matches of each kind (``base``) and looser ones that labelers propose: by shape (spelled-out
addresses, national phone numbers, long addresses, card-like numbers), by a gazetteer (known mail hosts without their
domain, international prefixes) and by context (digits after a word such as *phone* or *card*, groups after *ip*). Labelers
vote on each candidate, for (1), against (-1) or not at all (0): the strict pattern, a gazetteer (domains, calling codes,
issuers, reserved ranges), the words around, a checksum, and how the span is set off. Candidates are counted by kind,
votes and surface, a table of fixed maximal size; expectation-maximisation over these counts estimates how reliable each
labeler is for each kind, and a logistic span classifier over votes and surface (length, share of digits) is fitted to the
resulting posteriors. Base spans always stay; a loose candidate is added if the classifier gives it at least one half and
it meets no base span.

Offsets are code points, the end exclusive. They follow from the lengths of matches and of the pieces between them, summed
in two levels; loose spans meet base spans by their ranks in one sorted array, and a text is redacted from pieces joined once,
so a text with many spans costs little more than linear time. Patterns start at the first character of a run and use
possessive repeats: long runs of letters or digits cost linear time and constant stack.

What labelers propose has bounds that its kind has anyway: the part before a spelled-out *at* has at most 64 characters, a
label of a host 63, a host four *dot* groups, and what follows a word that announces a phone at most 22 signs; longer ones are not proposed. They never
touch base spans. The words around a span are the ``AROUND`` characters next to it, and end at the next match of its kind.

A null text is an empty one. Repeated rows and null ids are handled row by row; an empty table gives no rows. Only the text
is read; the result replaces a column of its name, all others stay as they are.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("pattern", "gazetteer", "context", "checksum", "setting")
# Fixed patterns. A base pattern here finds the leftmost non-overlapping matches of the plain one in its comment.
BASE = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    # [0-9]([ -]?[0-9])+ of 16 to 19 digits
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a shape labeler proposes.
SHAPED = {
    "email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+(?: ?[\[(]at[\])] ?[a-z0-9-]{1,63}+(?: ?(?:[\[(]dot[\])]|\.) ?[a-z0-9-]{1,63}+){1,4}| at [a-z0-9-]{1,63}+(?: dot [a-z0-9-]{1,63}+){1,4})",
    "ip": r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:.])",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])",
    "phone": r"(?<![+0-9A-Za-z(./-])(?<!\+[0-9]{1,3}[ -])(?:\(0?[0-9]{2,4}\)|0[0-9]{1,4}|[0-9]{3})[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9A-Za-z]|[.-][0-9])",
}
#: What a gazetteer labeler proposes: mail hosts that are known without a domain, numbers with an international prefix.
LISTED = {
    "email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+ ?@ ?(?:gmail|googlemail|yahoo|hotmail|outlook|protonmail|icloud|gmx|web\.de)(?![a-z0-9.-])",
    "phone": r"(?<![0-9A-Za-z+])00(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])[ ./-]?[0-9]{2,4}(?:[ ./-]?[0-9]{2,4}){1,3}+(?![0-9A-Za-z])",
}
#: What a context labeler proposes: what follows a word that announces the kind.
ANNOUNCED = {
    "ip": r"(?i)(?<=\bip[: ]{1,2}|\bip address[: ]{1,2}|\baddress[: ]{1,2})(?:[0-9a-f]{0,4}:){2,7}[0-9a-f]{1,4}(?![0-9A-Za-z:.])",
    "card": r"(?i)(?<=\bcard[: #]{1,2}|\bcard number[: #]{1,2}|\bkarte[: #]{1,2}|\btarjeta[: #]{1,2}|\bcarte[: #]{1,2})[0-9]{4}(?:[ ./-]?[0-9]{4}){2}[ ./-]?[0-9]{1,7}(?![0-9])",
    "phone": r"(?i)(?<=\bphone[: .]{1,2}|\btel[: .]{1,2}|\bmobile[: .]{1,2}|\bcall[: .]{1,2}|\bfax[: .]{1,2}|\btelefon[: .]{1,2}|\btel[ée]fono[: .]{1,2})[(0-9][0-9 ()./-]{5,20}[0-9](?![0-9A-Za-z])",
}
LOOSE = {k: "|".join(f"(?:{x[k]})" for x in (SHAPED, LISTED, ANNOUNCED) if k in x) for k in KINDS}
#: A text without this holds no match; it is tested before the pattern.
HINT = {"email": "[@]", "ip": r"[0-9]\.", "card": "[0-9][ -]?[0-9]", "phone": r"\+[0-9]"}
LOOSE_HINT = {"email": r"(?i)[\[(]at[\])]| dot |@", "ip": "[0-9A-Fa-f]:[0-9A-Fa-f:]", "card": "[0-9][ ./-]?[0-9]", "phone": "[0-9][ ()./-]{0,2}[0-9]"}
OCTETS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.|$)){4}$"
# Fixed gazetteers, as patterns over a match: those that speak for its kind, and those that speak against it.
KNOWN = {
    "email": r"(?i)(?:\.|dot[\])]? ?)(?:com|org|net|edu|gov|info|io|eu|de|fr|es|it|nl|uk|us|ca|ch|at|be|pl|pt|se|br|jp|cn|in|au)$",
    "ip": r"^(?!0|127\.|22[4-9]\.|2[3-5][0-9]\.)",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|3[0689]|35|6011|64|65|62)",
    "phone": r"^(?:\+?(?:1|7|2[07]|3[0-46-9]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|2[1-69][0-9]|3[578][0-9]|42[013]|5[09][0-9]|67[0-9]|8[0-58][0-9]|9[679][0-9])[ (.-]?|\(|0)",
}
RESERVED = {
    # roles, and plain words around "at" and "dot" that end in no known domain
    "email": r"(?i)(?:^|[^a-z])(?:noreply|no-reply|postmaster|mailer-daemon)| at [a-z0-9 -]+ dot (?!(?:com|org|net|edu|gov|info|io|eu|de|fr|es|it|nl|uk|us|ca|ch|at|be|pl|pt|se|br|jp|cn|in|au)$)[a-z0-9-]+$",
    "ip": r"^(?:0|127\.|22[4-9]\.|2[3-5][0-9]\.)", "card": r"^(?:0|1|9)", "phone": r"^\+0",
}
NEAR = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write to|reach|correo|courriel|adresse?)\b",
    "ip": r"(?i)\b(?:ip|ipv[46]|host|server|address|addr|login from|adresse|client)\b",
    "card": r"(?i)\b(?:card|credit|debit|visa|master ?card|amex|karte|carte|tarjeta|payment|cvv)\b",
    "phone": r"(?i)\b(?:phone|tel|telephone|mobile|cell|call|fax|whatsapp|telefon|t[ée]l[ée]phone|tel[ée]fono|m[óo]vil|handy)\b",
}
AGAINST = r"(?i)\b(?:version|ver|v|release|isbn|issn|order|invoice|serial|section|page|figure|table|sku|id|doi)[.:# ]{0,3}$"
AROUND = 40
#: Surface of a span: classes of its length and of its share of digits.
SIZES, SHAPES = 5, 4


def running(values: str, step: str = "s + v", zero: str = "0") -> Column:
    """Inclusive running results of an associative ``step`` (of s and v) over an array column of ints, by blocks of 64."""
    fold = lambda array, start: f"aggregate({array}, {start}, (s, v) -> {step})"
    return F.expr(f"""transform(array(transform(sequence(0, greatest(size({values}) - 1, 0) div 64), b -> {fold(f"slice({values}, b * 64 + 1, 64)", zero)})),
        blocks -> transform(array(transform(blocks, (x, b) -> {fold("slice(blocks, 1, b)", zero)})),
        before -> transform({values}, (v, i) -> {fold(f"slice({values}, (i div 64) * 64 + 1, i % 64 + 1)", "before[i div 64]")})))[0][0]""")


def _with_matches(df: DataFrame, text: str, name: str, kind: str, pattern: str, hint: str, loose: bool) -> DataFrame:
    """Adds ``name``: the candidates of one kind, with their votes but without the final choice."""
    m, g, at = f"{name}m", f"{name}g", f"{name}a"
    none = F.array().cast("array<string>")
    df = df.withColumn(m, F.when(F.col(text).rlike(hint), F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))).otherwise(none))
    df = df.withColumn(g, F.when(F.size(m) > 0, F.split(F.col(text), pattern, -1)).otherwise(none))
    df = df.withColumn(at, F.expr(f"transform({m}, (x, i) -> length({g}[i]) + if(i > 0, length({m}[i - 1]), 0))"))
    df = df.withColumn(at, F.when(F.size(at) > 0, running(at)).otherwise(F.col(at)))

    def span(x: Column, i: Column) -> Column:
        start = F.get(F.col(at), i)
        before, after = F.right(F.get(F.col(g), i), F.lit(AROUND)), F.left(F.get(F.col(g), i + 1), F.lit(AROUND))
        digits = F.regexp_replace(x, "[^0-9]", "")
        if kind == "card":
            valid = luhn(digits)
        elif kind == "ip":
            valid = x.rlike(OCTETS)
        elif kind == "phone":
            valid = F.length(digits).between(8, 15)
        else:
            valid = F.lit(True)
        base = F.lit(False) if loose else valid
        checked = kind == "card" or kind == "ip" and not loose
        votes = {
            "pattern": F.when(base, 1).otherwise(0),
            "gazetteer": F.when(x.rlike(RESERVED[kind]), -1).when(x.rlike(KNOWN[kind]), 1).otherwise(0),
            "context": F.when(before.rlike(AGAINST), -1).when(before.rlike(NEAR[kind]) | after.rlike(NEAR[kind]), 1).otherwise(0),
            "checksum": F.when(valid, 1).otherwise(-1) if checked else F.lit(0),
            "setting": F.when(before.rlike(r"[\p{L}\p{N}_#/=]$") | after.rlike(r"^[\p{L}\p{N}_=/]"), -1).otherwise(1),
        }
        return F.struct(
            F.lit(KINDS.index(kind)).alias("rank"), start.alias("start"), (start + F.length(x)).alias("end"), base.alias("base"),
            *[v.cast("int").alias(k) for k, v in votes.items()], F.least(F.length(x) / 8, F.lit(SIZES - 1)).cast("int").alias("size"),
            F.floor(F.length(digits) * (SHAPES - 1) / F.length(x)).cast("int").alias("shape"), valid.alias("valid"),
        )

    return df.withColumn(name, F.transform(m, span)).drop(m, g, at)


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    value = lambda i: F.substring(digits, i, F.lit(1)).cast("int")
    doubled = lambda i: value(i) * F.when((F.length(digits) - i) % 2 == 1, 2).otherwise(1)
    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda s, i: s + doubled(i) - F.when(doubled(i) > 9, 9).otherwise(0))
    return total % 10 == 0


def with_candidates(df: DataFrame, text: str = "text", out: str = "candidates") -> DataFrame:
    """Adds the candidate spans of each whole text: the valid base spans and the loose ones that meet none of these.

    A loose span meets a base span if one of those that start before its end reaches beyond its start. How many start
    before its end follows from its place among the sorted starts and ends, how far these reach from a running maximum.
    """
    columns = [c for c in df.columns if c.lower() != out.lower()]
    stem = common.free_name(df, "pii", out)
    while any(c.lower().startswith(stem) for c in df.columns):
        stem += "_"
    t, base, loose, far, place = (f"{stem}{x}" for x in ("text", "base", "loose", "far", "place"))
    df = df.withColumn(t, common.text_or_empty(text))
    names = {(k, x): f"{stem}{k}_{x}" for k in KINDS for x in ("base", "loose")}
    for kind in KINDS:
        df = _with_matches(df, t, names[kind, "base"], kind, BASE[kind], HINT[kind], loose=False)
        df = _with_matches(df, t, names[kind, "loose"], kind, LOOSE[kind], LOOSE_HINT[kind], loose=True)
    by = lambda c, *key: f"array_sort({c}, (a, b) -> case when {key[0]} < {key[1]} then -1 when {key[0]} > {key[1]} then 1 else 0 end)"
    df = df.withColumn(base, F.filter(F.concat(*[F.col(names[k, "base"]) for k in KINDS]), lambda s: s["base"]))
    df = df.withColumn(base, F.expr(by(base, "a.start", "b.start")))
    df = df.withColumn(loose, F.expr(by(f"concat({', '.join(names[k, 'loose'] for k in KINDS)})", "a.end", "b.end")))
    both = (F.size(base) > 0) & (F.size(loose) > 0)
    df = df.withColumn(far, F.expr(f"transform({base}, s -> s.end)")).withColumn(far, F.when(both, running(far, "greatest(s, v)")))
    # a base span that starts where the loose one ends comes after it
    merged = f"array_sort(concat(transform({base}, s -> 2 * s.start + 1), transform({loose}, s -> 2 * s.end)))"
    df = df.withColumn(place, F.when(both, F.expr(f"filter(transform({merged}, (x, i) -> if(x % 2 = 0, i, -1)), i -> i >= 0)")))
    free = F.expr(f"filter({loose}, (s, j) -> {place} is null or {place}[j] = j or {far}[{place}[j] - j - 1] <= s.start)")
    df = df.withColumn(out, F.when(F.size(loose) > 0, F.array_sort(F.concat(F.col(base), free))).otherwise(F.array_sort(base)))
    return df.select(*columns, out)


# -- reliabilities and the span classifier ---------------------------------------------------------------------------


@dataclass
class SpanModel:
    """``weights[kind]``: the intercept, the weights of each labeler's vote for and against, of length classes, of digit shares."""

    reliabilities: dict[str, dict[str, tuple[float, float]]]
    weights: list[list[float]]

    def probability(self, s: Column) -> Column:
        z = None
        for rank, w in enumerate(self.weights):
            terms = F.lit(w[0])
            for j, name in enumerate(LABELERS):
                terms = terms + F.when(s[name] == 1, w[1 + 2 * j]).when(s[name] == -1, w[2 + 2 * j]).otherwise(0.0)
            for at, (name, n) in zip((1 + 2 * len(LABELERS), 1 + 2 * len(LABELERS) + SIZES), (("size", SIZES), ("shape", SHAPES)), strict=True):
                for i in range(n):
                    terms = terms + F.when(s[name] == i, w[at + i]).otherwise(0.0)
            z = F.when(s["rank"] == rank, terms) if z is None else z.when(s["rank"] == rank, terms)
        return 1 / (1 + F.exp(-z))

    def spans(self, candidates: str | Column) -> Column:
        """Base spans and the loose ones the classifier takes, by kind and start."""
        return F.filter(candidates, lambda s: s["base"] | (self.probability(s) >= 0.5))


def vote_counts(df: DataFrame, candidates: str = "candidates") -> list:
    """How often each kind, vote pattern and surface occurs: at most 4 x 3^5 x 20 rows, whatever the corpus."""
    return df.where(F.size(candidates) > 0).select(F.explode(candidates).alias("s")).groupBy("s.rank", *[f"s.{x}" for x in LABELERS], "s.size", "s.shape").count().collect()


def fit(df: DataFrame, candidates: str = "candidates", rounds: int = 50) -> SpanModel:
    """Expectation-maximisation over the vote counts, then a logistic fit to the posteriors, for each kind.

    Every labeler starts as better than chance, with the weight of a few candidates, so that a kind with few candidates,
    or none, keeps these. ``df`` should be a pinned table of candidates, or its filters meet the patterns themselves.
    """
    counts = vote_counts(df, candidates)
    reliabilities, weights = {}, []
    for rank, kind in enumerate(KINDS):
        rows = sorted((tuple(r[1:-3]), (r[-3], r[-2]), r[-1]) for r in counts if r[0] == rank)
        share, given = 0.5, {(x, y, v): ((0.6 if (v == 1) == y else 0.1) if v else 0.3) for x in range(len(LABELERS)) for y in (True, False) for v in (-1, 0, 1)}
        start = dict(given)
        for _ in range(rounds):
            posterior = [_posterior(votes, share, given) for votes, _, _ in rows]
            yes, all_ = sum(p * n for p, (_, _, n) in zip(posterior, rows, strict=True)), sum(n for _, _, n in rows)
            share = (yes + 2) / (all_ + 4)
            for x in range(len(LABELERS)):
                for y in (True, False):
                    seen = {v: 8 * start[x, y, v] for v in (-1, 0, 1)}
                    for p, (votes, _, n) in zip(posterior, rows, strict=True):
                        seen[votes[x]] += n * (p if y else 1 - p)
                    for v in seen:
                        given[x, y, v] = seen[v] / sum(seen.values())
        reliabilities[kind] = {name: (given[x, True, 1], given[x, False, -1]) for x, name in enumerate(LABELERS)}
        # one pattern of each vote, weightless in large data, anchors the classifier to the estimated reliabilities
        anchors = [(tuple(v if i == x else 0 for i in range(len(LABELERS))), (s, s % SHAPES), 1) for x in range(len(LABELERS)) for v in (-1, 0, 1) for s in range(SIZES)]
        weights.append(_logistic([(votes, surface, n, _posterior(votes, share, given)) for votes, surface, n in rows + anchors]))
    return SpanModel(reliabilities, weights)


def _posterior(votes: tuple, share: float, given: dict) -> float:
    z = math.log(share / (1 - share)) + sum(math.log(given[x, True, v] / given[x, False, v]) for x, v in enumerate(votes))
    return 1 / (1 + math.exp(-max(-30, min(30, z))))


def _logistic(rows: list[tuple], rounds: int = 300, ridge: float = 0.01) -> list[float]:
    """Weights by gradient steps over a few hundred weighted patterns with soft targets."""
    at, total = 1 + 2 * len(LABELERS), sum(math.log1p(n) for _, _, n, _ in rows)
    width = at + SIZES + SHAPES
    active = [([0] + [1 + 2 * x + (v == -1) for x, v in enumerate(votes) if v] + [at + size, at + SIZES + shape], math.log1p(n) / total, p) for votes, (size, shape), n, p in rows]
    w = [0.0] * width
    for _ in range(rounds):
        step = [-ridge * x for x in w]
        for on, weight, p in active:
            error = weight * (p - 1 / (1 + math.exp(-sum(w[i] for i in on))))
            for i in on:
                step[i] += error
        w = [x + 2 * s for x, s in zip(w, step, strict=True)]
    return w


def find_pii(docs: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """Adds ``out``, the spans (rank, start, end, base, votes...) of each text; the model is fitted on all the documents.

    The candidates are pinned: they are read twice, and filters that the optimizer derives from the counting would otherwise
    be pushed into the expressions that find them, once for each of their parts.
    """
    found = common.pin(with_candidates(docs, text, out), "pii-candidates")
    return found.withColumn(out, fit(found, out).spans(out))


CHUNK = 1024


def redact(df: DataFrame, text: str = "text", spans: str = "pii", out: str = "redacted") -> DataFrame:
    """Adds ``out``, the text with its spans replaced by their kind in brackets; spans that overlap are replaced together, by
    the kind of the first, of those that start with it the longest.

    The text between spans is taken from chunks of the text, as a place in a long text is only found by counting to it.
    """
    stem = common.free_name(df, "redact", out)
    while any(c.lower().startswith(stem) for c in df.columns):
        stem += "_"
    order, far, first, chunks = (f"{stem}{x}" for x in ("order", "far", "first", "chunks"))
    kinds = F.array(*map(F.lit, KINDS))
    columns = [c for c in df.columns if c.lower() != out.lower()]
    df = df.withColumn(order, F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("neg"), F.element_at(kinds, s["rank"] + 1).alias("kind")))))
    df = df.withColumn(far, F.expr(f"transform({order}, s -> -s.neg)")).withColumn(far, F.when(F.size(far) > 0, running(far, "greatest(s, v)")))
    # the first span of each group of overlapping ones
    df = df.withColumn(first, F.expr(f"filter(transform({order}, (s, i) -> if(i = 0 or s.start >= {far}[i - 1], i, -1)), i -> i >= 0)"))
    df = df.withColumn(chunks, F.when(F.size(first) > 0, F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))))
    cut = lambda a, b: f"substring(array_join(slice({chunks}, ({a}) div {CHUNK} + 1, ({b}) div {CHUNK} - ({a}) div {CHUNK} + 1), ''), ({a}) % {CHUNK} + 1, ({b}) - ({a}))"
    begin = f"if(g = 0, 0, {far}[i - 1])"  # where the group before ended
    pieces = f"transform({first}, (i, g) -> concat({cut(begin, f'{order}[i].start')}, '[', {order}[i].kind, ']'))"
    tail = cut(f"{far}[size({far}) - 1]", f"length({text})")
    masked = F.expr(f"array_join(concat({pieces}, array({tail})), '')")
    return df.withColumn(out, F.when(F.size(first) > 0, masked).otherwise(F.col(text))).select(*columns, out)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_candidates(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = common.pin(found.select("doc_id", "candidates"), "pii-candidates")
    spans = found.select("doc_id", fit(found).spans("candidates").alias("spans"))
    kinds = F.array(*map(F.lit, KINDS))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", F.element_at(kinds, s["rank"] + 1), s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["base"])
    count = lambda r, kind: F.size(F.filter("spans", lambda s: s["base"] & (s["rank"] == r))).cast("long").alias(f"n_{kind}")
    return spans.select("doc_id", *[count(r, k) for r, k in enumerate(KINDS)], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
