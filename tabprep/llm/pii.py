"""Personal data: base patterns, and terms that disclose the entities they name.

Base spans (email, ip, card, phone) come from patterns and checks.  The
information-theoretic part protects the entities that base values name: the value itself, and what it
has in common with others (an email's domain, an ip's first three parts, a card's first
six digits, a phone number without its last four).  Terms are words outside emails.  Co-occurrence is counted in the distinct texts
of the corpus, each as a whole, however far apart term and entity stand.  With n texts in all,

    IC(entity) = -ln(n_entity / n)
    PMI(entity, term) = ln(n_both * n / (n_entity * n_term))

a term discloses an entity if PMI / IC reaches ``threshold``, that is, if seeing
the term gives away that share of the information the entity holds, and if so many
common texts are no chance: with e = n_entity * n_term / n texts expected, the Chernoff
bound exp(-(n_both * ln(n_both / e) - n_both + e)) of that many or more is at most ``level`` / n.
Every occurrence of the term in every document that holds the entity is a span of kind ``term``.

What cannot disclose is left out before pairs are made, by consequences of the two rules: an entity or
a term in one text only never passes the second, and a term passes the first only if
n_term <= n_entity**threshold * n**(1 - threshold).

Only DataFrame functions are used.  The spans of a text are found from the pieces
between matches, whose lengths are summed in a window over the matches of the text:
linear in the text's length, without a nested array for each text.  The patterns
are written with possessive repeats and a look-behind, which match what the plain
patterns match but neither recurse nor restart inside a failed run.

Defined cases: a NULL text is empty and has no spans; rows with equal
(doc_id, text) get equal results, one row each, and copies of a text count once as evidence; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabprep.functions.names import unused

from .common import BROADCAST_ROWS, materialize, small

#: Kinds in order, and their patterns.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A character that every match of the kind holds: texts without it are not searched.
NEEDED = {"email": "@", "ip": ".", "card": None, "phone": "+"}
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"

THRESHOLD = 0.8
LEVEL = 0.05
TERM = r"[\p{L}][\p{L}\p{N}]{2,}+"
#: In texts with an "@": emails, which are dropped from the terms, or terms that do not run into one.
EMAIL_OR_TERM = PATTERNS["email"] + "|" + TERM + r"(?![A-Za-z0-9._%+-]*+@[A-Za-z0-9-]++\.[A-Za-z0-9-])"


def valid(kind: Column, match: Column) -> Column:
    """The checks that a pattern cannot state."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    size = F.length(digits)
    return (F.when(kind == "ip", match.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$"))
            .when(kind == "card", size.between(14, 19) & F.coalesce(F.call_function("luhn_check", digits), F.lit(False)))
            .when(kind == "phone", size.between(10, 15)).otherwise(True))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(d, t, text): a document is known by its id and its text's hash."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("d"), F.xxhash64(text).alias("t"), text.alias("text"))


def base_matches(docs: DataFrame) -> DataFrame:
    """(d, t, kind, match, start, end) of every valid base span of keyed documents."""
    found = []
    for kind in KINDS:
        pattern = PATTERNS[kind].replace("\\", "\\\\")
        has = F.lit(True) if NEEDED[kind] is None else F.contains(F.col("text"), F.lit(NEEDED[kind]))
        found.append(F.when(has, F.struct(
            F.lit(kind).alias("kind"), F.expr(f"regexp_extract_all(text, '{pattern}', 0)").alias("matches"),
            F.split("text", PATTERNS[kind], -1).alias("pieces"))))
    per_kind = docs.select("d", "t", F.explode_outer(F.array(*found)).alias("k")).filter("size(k.matches) > 0")
    # A row holds its own match and the length of the piece before it, never the arrays; behind the last piece is no match.
    pairs = F.arrays_zip(F.transform("k.pieces", F.length).alias("gap"), F.col("k.matches").alias("match"))
    rows = per_kind.select("d", "t", "k.kind", F.posexplode_outer(pairs).alias("i", "m")).select(
        "d", "t", "kind", "i", F.col("m.match").alias("match"), F.col("m.gap").cast("long").alias("gap")).filter("match is not null")
    once = rows.repartition("d", "t").dropDuplicates(["d", "t", "kind", "i"])
    upto = Window.partitionBy("d", "t", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    ends = once.withColumn("end", F.sum(F.col("gap") + F.length("match")).over(upto))
    return ends.filter(valid(F.col("kind"), F.col("match"))).select(
        "d", "t", "kind", "match", (F.col("end") - F.length("match")).alias("start"), "end")


def entities(kind: Column, match: Column) -> Column:
    """The entities that a base value names: itself, and what it shares with others."""
    low, digits = F.lower(match), F.regexp_replace(match, "[^0-9]", "")
    named = lambda k, *values: F.array(*[F.concat(F.lit(f"{k}{i}:"), v) for i, v in enumerate(values)])
    return (F.when(kind == "email", named("email", low, F.substring_index(low, "@", -1)))
            .when(kind == "ip", named("ip", match, F.substring_index(match, ".", 3)))
            .when(kind == "card", named("card", digits, F.left(digits, F.lit(6))))
            .otherwise(named("phone", digits, F.expr("left(regexp_replace(match, '[^0-9]', ''), "
                                                     "greatest(length(regexp_replace(match, '[^0-9]', '')) - 4, 1))"))))


def term_array(text: Column) -> Column:
    """Distinct lower-cased terms of a text."""
    mixed = F.filter(F.regexp_extract_all(text, F.lit(EMAIL_OR_TERM), F.lit(0)), lambda x: ~F.contains(x, F.lit("@")))
    plain = F.regexp_extract_all(text, F.lit(TERM), F.lit(0))
    return F.array_distinct(F.transform(F.when(F.contains(text, F.lit("@")), mixed).otherwise(plain), F.lower))


def distinct_texts(source: DataFrame) -> DataFrame:
    """(t, text): every text once. Only texts that several rows have are looked up and shuffled."""
    copies = materialize(source.groupBy("t").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("first")).filter("n > 1").select(
        F.col("t").alias("t2"), "first"), "pii-copies")
    hinted = small(copies)
    single = source.join(hinted, F.col("t") == F.col("t2"), "left_anti").select("t", "text")
    shared = source.join(hinted, (F.col("t") == F.col("t2")) & F.col("d").eqNullSafe(F.col("first"))).select("t", "text")
    return single.unionByName(shared.dropDuplicates(["t"]))


def disclosing(source: DataFrame, held: DataFrame, threshold: float, level: float) -> DataFrame:
    """(entity, term) pairs that disclose, from the distinct (t, entity) of the corpus."""
    total = source.agg(F.count_distinct("t").alias("n")).first().n  # one number
    counted = held.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"))
    recurring = materialize(counted.filter(F.col("n_entity").between(2, total - 1)), "pii-entities")  # all texts: IC is 0
    if not recurring.head(1):
        return source.sparkSession.createDataFrame([], "entity string, term string")
    known = materialize(held.join(small(recurring), "entity"), "pii-held")  # (entity, t, n_entity)
    n = float(total)
    texts = distinct_texts(source)
    of_texts = known.select(F.col("t").alias("t2")).distinct()
    inside = materialize(texts.join(small(of_texts), F.col("t") == F.col("t2"), "left_semi").select(
        "t", F.explode(term_array(F.col("text"))).alias("term")), "pii-terms")
    # A term that discloses is in two of these texts at least, and in no more of all texts than the most frequent entity allows.
    most = recurring.agg(F.max("n_entity").alias("most")).first().most
    bound = lambda n_entity: F.pow(n_entity, F.lit(threshold)) * n ** (1 - threshold) * (1 + 1e-9)
    wanted = materialize(inside.groupBy("term").agg(F.count(F.lit(1)).alias("n_inside")).filter(
        (F.col("n_inside") >= 2) & (F.col("n_inside") <= bound(F.lit(float(most))))).select("term"), "pii-wanted")
    words = texts.select("t", F.explode_outer(term_array(F.col("text"))).alias("term"))
    # Counted before they are joined, so that a task sends a term once, not with every text that has it.
    n_term = materialize(words.groupBy("term").agg(F.count(F.lit(1)).alias("n_term")).filter(
        F.col("n_term") <= bound(F.lit(float(most)))).join(wanted, "term"), "pii-counts")
    pairs = inside.join(small(n_term), "term").join(known, "t").filter(F.col("n_term") <= bound(F.col("n_entity")))
    both = pairs.groupBy("entity", "term", "n_entity", "n_term").agg(F.count(F.lit(1)).alias("n_both"))
    expected = F.col("n_entity") * F.col("n_term") / n
    share = F.log(F.col("n_both") / expected) / -F.log(F.col("n_entity") / n)
    surprise = F.col("n_both") * F.log(F.col("n_both") / expected) - F.col("n_both") + expected
    return both.filter((F.col("n_both") > expected) & (share >= threshold) & (surprise >= math.log(n / level))).select("entity", "term")


def term_spans(source: DataFrame, held: DataFrame, pairs: DataFrame) -> DataFrame:
    """(d, t, kind, start, end) of every occurrence of a disclosing term in the documents that hold its entity."""
    accepted = materialize(held.join(small(pairs), "entity").select("t", "term").distinct(), "pii-accepted")
    texts = source.join(small(accepted.select(F.col("t").alias("t2")).distinct()), F.col("t") == F.col("t2"), "left_semi")
    pairs = F.arrays_zip(F.transform(F.split("text", EMAIL_OR_TERM, -1), F.length).alias("gap"),
                         F.regexp_extract_all("text", F.lit(EMAIL_OR_TERM), F.lit(0)).alias("match"))
    found = texts.select("d", "t", F.posexplode_outer(pairs).alias("i", "m")).select(
        "d", "t", "i", F.col("m.match").alias("match"), F.col("m.gap").cast("long").alias("gap")).filter("match is not null")
    once = found.repartition("d", "t").dropDuplicates(["d", "t", "i"])
    upto = Window.partitionBy("d", "t").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    ends = once.withColumn("end", F.sum(F.col("gap") + F.length("match")).over(upto)).withColumn("term", F.lower("match"))
    return ends.join(small(accepted), ["t", "term"]).select(
        "d", "t", F.lit("term").alias("kind"), (F.col("end") - F.length("match")).alias("start"), "end")


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD,
               level: float = LEVEL) -> DataFrame:
    """(d, t, kind, start, end) of all base and term spans; places are code points, ends exclusive."""
    source = keyed(docs, id_col, text_col)
    matches = materialize(base_matches(source), "pii-matches")
    held = materialize(matches.select("t", F.explode(entities(F.col("kind"), F.col("match"))).alias("entity")).distinct(), "pii-named")
    spans = matches.select("d", "t", "kind", "start", "end")
    pairs = materialize(disclosing(source, held, threshold, level), "pii-pairs")
    return spans.unionByName(term_spans(source, held, pairs)) if pairs.head(1) else spans


def order_of(kind: Column) -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in (*KINDS, "term")]), kind)


def documents_with_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, t, and spans: array of (start, order, end, kind) by start and kind, for every document."""
    spans = find_spans(docs, id_col, text_col, **options)
    grouped = spans.groupBy("d", "t").agg(F.array_sort(F.collect_list(F.struct(
        "start", order_of(F.col("kind")).alias("order"), "end", "kind"))).alias("spans")).withColumnsRenamed({"d": "d2", "t": "t2"})
    source = keyed(docs, id_col, text_col).select("d", "t")
    joined = source.join(grouped, F.col("d").eqNullSafe(F.col("d2")) & (F.col("t") == F.col("t2")), "left")
    return joined.select(F.col("d").alias(id_col), "t",
                         F.coalesce("spans", F.array().cast(grouped.schema["spans"].dataType)).alias("spans"))


def listed(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with every span generalised to its kind in brackets; spans that overlap become one, named after the first."""
    spans = find_spans(docs, id_col, text_col, **options)
    before = Window.partitionBy("d", "t").orderBy("start", "order").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("d", "t").orderBy("start", "order").rowsBetween(Window.unboundedPreceding, 0)
    islands = (spans.withColumn("order", order_of(F.col("kind")))
               .withColumn("new", (F.col("start") >= F.coalesce(F.max("end").over(before), F.lit(0))).cast("int"))
               .withColumn("island", F.sum("new").over(upto)).groupBy("d", "t", "island")
               .agg(F.min(F.struct("start", "order", "kind")).alias("first"), F.max("end").alias("end")))
    d, t, own = (unused(docs.columns, name) for name in ("__d", "__t", "__cuts"))
    cuts = islands.groupBy("d", "t").agg(F.array_sort(F.collect_list(F.struct(
        F.col("first.start").alias("start"), "end", F.col("first.kind").alias("kind")))).alias(own)).withColumnsRenamed({"d": d, "t": t})
    text, cut = F.col(text_col), F.col(own)
    piece = lambda c, i: F.concat(
        F.substring(text, (F.coalesce(F.get(cut, i - 1)["end"], F.lit(0)) + 1).cast("int"),
                    (c["start"] - F.coalesce(F.get(cut, i - 1)["end"], F.lit(0))).cast("int")),
        F.lit("["), F.upper(c["kind"]), F.lit("]"))
    tail = F.substring(text, (F.get(cut, F.size(cut) - 1)["end"] + 1).cast("int"), F.length(text))
    changed = F.when(cut.isNull(), text).otherwise(F.concat(F.concat_ws("", F.transform(cut, piece)), tail))
    key = F.xxhash64(F.coalesce(docs[text_col], F.lit("")))
    same = docs[id_col].eqNullSafe(F.col(d)) & (key == F.col(t))
    cuts = materialize(cuts, "pii-cuts")
    few = cuts.select(d, t)  # rows of bounded width
    if few.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        return docs.join(cuts, same, "left").withColumn(text_col, changed).select(*docs.columns)
    # Only the texts that change are shuffled to their cuts, which may be long; the others stay where they are.
    touched = docs.join(F.broadcast(few), same, "left_semi")
    again = F.xxhash64(F.coalesce(touched[text_col], F.lit("")))
    return docs.join(F.broadcast(few), same, "left_anti").unionByName(touched.join(
        cuts, touched[id_col].eqNullSafe(F.col(d)) & (again == F.col(t))).withColumn(text_col, changed).select(*docs.columns))
