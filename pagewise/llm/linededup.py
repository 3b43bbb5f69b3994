"""Line dedup with a log-template tree.

A line is parsed at a fixed depth: by its number of tokens, then by its leading tokens, then by
hashes of SEGMENTS equal runs of its tokens. Tokens with a digit are variable fields and read as
`<*>`. Fields that vary without digits are generalised by further templates within the leaf of one
token count and the same leading tokens. A line of LONG tokens or more has the templates that leave
two segments out, so that any two variable words after the leading ones are covered. A line of SHORT
tokens or more that isn't long has the templates that leave out one of SEGMENTS runs of its tokens
after the leading ones, so that a field of one token or several is covered; such a template counts if
at least VALUES different lines have it, as two may differ by chance.

A line of under SHORT tokens of which masking would leave nothing but `<*>` (a page number, say) has
its tokens as they are for a template, so that different numbers stay apart.

A template that recurs across documents is boilerplate: its lines stay in the first document that
has it (least doc_id) and are dropped from the others. A line of under SHORT tokens must be in one
document more than others to count as boilerplate, so such a line in just two documents stays. Lines
of under SHORT tokens without a word, which part paragraphs, have no template.

Everything is by keys: templates are counted with partial sums, and each document gets the places
of its own lines that it has to drop, so no group is ever gathered.

Edge cases: null and empty texts have no lines to drop and stay; rows of one doc_id are one
document, those without one another, which comes last; a repeated line within one document isn't
across documents and stays; documents of which nothing is left are kept as empty
texts here (`deduplicated` drops them); extra columns stay, those named n_lines or n_dropped with
`_given` after their name (`deduplicated` returns all as they were); an empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, set_aside, stored, unused_name

SHORT, LEADING, SEGMENTS, LONG = 5, 2, 4, 16
#: Different lines that show a field of a line that isn't long to be variable.
VALUES = 3
#: The last two bits of a key: of a template counted by documents alone, of a short line, of one with a run of tokens left out.
PLAIN, OF_SHORT, ONE_OUT = 0, 1, 2
PAIRS = [(j, k) for j in range(SEGMENTS) for k in range(j + 1, SEGMENTS)]
#: What stands for a null doc_id, so that it comes last.
LAST = 2**63 - 1
#: A token with a digit in it.
VARIABLE = r"[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+"


def plain(text: Column) -> Column:
    """White space other than line feeds reads as blanks, each of which ends a token."""
    return F.when(text.rlike("[\\x09\\x0B-\\x0D]"), F.translate(text, "\t\x0b\x0c\r", "    ")).otherwise(text)


def generalised(text: Column) -> Column:
    """Variable fields masked in a plain text."""
    return F.when(text.rlike("[0-9]"), F.regexp_replace(text, VARIABLE, "<*>")).otherwise(text)


def line_keys(text: Column) -> Column:
    """The keys of each line's templates, by place. Lines are masked one by one: few have digits."""
    return F.transform(lines_of(plain(text)), lambda exact: bound(generalised(exact), lambda line: templates(line, exact)))


def bound(value: Column, body) -> Column:
    """body(value), with value computed once however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def templates(line: Column, exact: Column) -> Column:
    """Keys of a generalised line's templates; the first is that of the whole line. exact is the line before masking."""
    return bound(F.split(line, " "), lambda tokens: _of_line(line, tokens, exact))


def _of_line(line: Column, tokens: Column, exact: Column) -> Column:
    nothing_fixed = ~line.rlike("[^<*> ]")
    short = F.when(~nothing_fixed, F.array(_short(tokens))).when(F.trim(exact) == "", F.array().cast("array<bigint>")).otherwise(F.array(_short(F.split(exact, " "))))
    return F.when(F.size(tokens) >= SHORT, _of_tokens(tokens)).otherwise(short)


def _short(tokens: Column) -> Column:
    return _marked(OF_SHORT, F.size(tokens), F.slice(tokens, 1, LEADING), tokens)


def _marked(kind: int, *of: Column) -> Column:
    return F.xxhash64(*of).bitwiseAND(F.lit(-4)).bitwiseOR(F.lit(kind))


def _of_tokens(tokens: Column) -> Column:
    n = F.size(tokens)
    lead = F.slice(tokens, 1, LEADING)

    def of_segments(segments: Column) -> Column:
        some = [_marked(PLAIN, n, lead, F.lit(j * SEGMENTS + k), F.array(*[segments[i] for i in range(SEGMENTS) if i not in (j, k)])) for j, k in PAIRS]
        whole = _marked(PLAIN, n, lead, F.lit(-1), segments)
        edge = lambda k: ((n - LEADING) * k / SEGMENTS).cast("int") + LEADING
        without = lambda k: _marked(ONE_OUT, n, F.lit(k), F.slice(tokens, 1, edge(k)), F.slice(tokens, edge(k + 1) + 1, n))
        one_out = [F.when(edge(k + 1) > edge(k), without(k)) for k in range(SEGMENTS)]
        return F.when(n >= LONG, F.array(whole, *some)).otherwise(F.array_compact(F.array(whole, *one_out)))

    cut = lambda k: (n * k / SEGMENTS).cast("int")
    segments = F.array(*[F.xxhash64(F.slice(tokens, cut(k) + 1, cut(k + 1) - cut(k))) for k in range(SEGMENTS)])
    return bound(segments, of_segments)


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def drops(spark: SparkSession, docs: DataFrame, min_docs: int, weighed: bool) -> DataFrame:
    """(id, text_hash, gone): the places of the lines that a document has to drop. If weighed, also most:
    the characters of its recurring lines that one document has first, the most of any."""
    sizes = [F.transform(lines_of(F.col("text")), lambda x: F.length(x)).alias("sizes")] if weighed else []
    per_doc = docs.filter("text is not null").select(_id().alias("id"), F.xxhash64("text").alias("text_hash"), line_keys(F.col("text")).alias("keys"), *sizes)
    table = stored(spark, per_doc, "templates")
    lines = table.select(*[c for c in table.columns if c != "keys"], F.posexplode("keys").alias("place", "line_keys")).filter(F.size("line_keys") > 0)
    if weighed:
        lines = lines.withColumn("size", F.get("sizes", F.col("place"))).drop("sizes")
    rows = lines.select(*[c for c in lines.columns if c != "line_keys"], F.explode("line_keys").alias("key"))
    of = lambda kind: F.col("key").bitwiseAND(F.lit(3)) == kind
    several = [F.count_distinct("id").alias("n")] if min_docs > 2 else []
    # a template recurs across documents if the first and the last that have it differ
    recurs = (F.col("first") < F.col("last")) & (F.col("n") >= min_docs if several else F.lit(True))
    found = rows.filter(of(PLAIN)).groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last"), *several).filter(recurs)
    short = rows.filter(of(OF_SHORT)).groupBy("key").agg(F.min("id").alias("first"), F.count_distinct("id").alias("n")).filter(F.col("n") > min_docs)
    wholes = lines.select("id", F.element_at("line_keys", 1).alias("whole"), F.explode("line_keys").alias("key")).filter(of(ONE_OUT))
    varied = wholes.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count_distinct("whole").alias("lines"), *several).filter(recurs & (F.col("lines") >= VALUES))
    found = found.select("key", "first").unionByName(short.select("key", "first")).unionByName(varied.select("key", "first"))
    if not weighed:
        return rows.join(found, "key").filter(F.col("id") > F.col("first")).groupBy("id", "text_hash").agg(F.collect_set("place").alias("gone"))
    # dealt by document once; what follows groups by more than that
    hits = rows.join(found, "key").select("id", "text_hash", "place", "size", "first").repartition("id", "text_hash")
    hits = hits.groupBy("id", "text_hash", "place").agg(F.min("first").alias("first"), F.max("size").alias("size"))
    by_first = hits.groupBy("id", "text_hash", "first").agg(F.sum("size").alias("size"), F.collect_list(F.when(F.col("id") > F.col("first"), F.col("place"))).alias("gone"))
    return by_first.groupBy("id", "text_hash").agg(F.flatten(F.collect_list("gone")).alias("gone"), F.max("size").alias("most"))


def _id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST).cast("long"))


def dedup_lines(spark: SparkSession, docs: DataFrame, *, min_docs: int = 2, spare_copies: bool = False) -> DataFrame:
    """docs with text cut, and n_lines and n_dropped as long (0 for a null text).

    spare_copies: a document of which more than half, in characters, are recurring lines that one and
    the same document has first is a copy of it, or that document itself, and stays whole. Cut, such
    copies would leave scraps that near-dedup can't match any more.
    """
    docs, _ = set_aside(docs, ("n_lines", "n_dropped"))
    id_, hash_, gone_, most_, kept_ = (unused_name(docs, x) for x in ("_id", "_hash", "_gone", "_most", "_kept"))
    gone = drops(spark, docs, min_docs, spare_copies).withColumnsRenamed({"id": id_, "text_hash": hash_, "gone": gone_, "most": most_})
    out = docs.join(gone, (_id() == F.col(id_)) & (F.xxhash64("text") == F.col(hash_)), "left")
    cut = F.size(gone_) > 0
    if spare_copies:
        cut = cut & (2 * F.col(most_) <= F.length("text"))
    lines = F.filter(lines_of(F.col("text")), lambda x, place: ~F.array_contains(F.col(gone_), place))
    out = out.withColumn(kept_, F.when(cut, lines))
    text = F.when(F.col(kept_).isNull(), F.col("text")).otherwise(F.array_join(kept_, "\n"))
    before = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long")
    left = F.when(F.col(kept_).isNull(), before).otherwise(F.size(kept_)).cast("long")
    cols = [text.alias(c) if c == "text" else column(c) for c in docs.columns]
    return out.select(*cols, before.alias("n_lines"), (before - left).alias("n_dropped"))


def deduplicated(spark: SparkSession, docs: DataFrame, *, min_docs: int = 2, spare_copies: bool = False) -> DataFrame:
    """docs with text cut, without the documents of which no word is left though some were dropped;
    n_chars, where there is one, follows the text."""
    _, names = set_aside(docs, ("n_lines", "n_dropped"))
    out = dedup_lines(spark, docs, min_docs=min_docs, spare_copies=spare_copies)
    out = out.filter((F.col("n_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(dict(docs.dtypes)["n_chars"]))
    return out.select(*[column(names.get(c, c)).alias(c) for c in docs.columns])
