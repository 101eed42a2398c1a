"""Line dedup by a deletion-neighbourhood join, with DataFrame functions only.

Lines are compared by their words. A line goes if an earlier line has the same
words, or is one word edit away (a word put in, left out or replaced) and has
at least MIN_WORDS words, as has the line itself. Earlier means by document id
(null first), text hash and place in the document.

Every line emits, as hashed keys, what is left when one of its words is taken
out, and itself with a gap at each place. Lines that share a key are within one
edit of each other, all of them, so the earliest of them decides; its edit
distance is verified on the words. Emitting keys for every line would be many
times the text. Two lines that are one edit apart share their first or their
last half, so only lines that share a half with another line emit keys, and
only for places in the other half; the same is then asked of the halves of that
half.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, materialize, table, whole_text

MIN_WORDS = 10
#: Words in a block whose hash stands for it when parts of long lines are hashed.
BLOCK = 32


def words_text(line: Column) -> Column:
    """The words of a line (what ASCII white space separates) between single blanks."""
    other = F.contains(line, F.lit("\t")) | F.contains(line, F.lit("\r")) | F.contains(line, F.lit("\x0b")) | F.contains(line, F.lit("\x0c"))
    x = F.when(other, F.translate(line, "\t\x0b\x0c\r", "    ")).otherwise(line)  # translate goes character by character
    return F.trim(F.when(F.contains(x, F.lit("  ")), F.regexp_replace(x, "  +", " ")).otherwise(x))


def _first(line: Column, n: Column) -> Column:
    """The first n words; the last ones if n is negative."""
    return F.call_function("substring_index", line, F.lit(" "), n)


def half_keys(line: Column, n: Column) -> Column:
    """Keys of the halves that a line of n words shares with lines one edit away:
    (base n, first half), (n, last half), (n - 1, first), (n - 1, last); null where none is asked for.

    base is the number of words of the shorter line of a pair; the first half
    has base div 2 words.
    """
    keys = []
    for base in (n, n - 1):
        m = F.shiftright(base, 1)
        keys += [F.when(base >= MIN_WORDS, F.xxhash64(F.lit(side), base, _first(line, count))) for side, count in ((0, m), (1, m - base))]
    return F.when(n >= MIN_WORDS, F.array(*keys))


def distinct_lines(docs: DataFrame) -> DataFrame:
    """docs (id, th, text) to one row per sequence of words: h1, h2, rank (its first occurrence), n (words) and halves.

    The words themselves stay behind: few lines need them again.
    """
    lines = docs.select("id", "th", F.posexplode(F.split("text", "\n")).alias("no", "line")).select("id", "th", "no", words_text(F.col("line")).alias("line")).filter("line <> ''")
    n = F.octet_length("line") - F.octet_length(F.replace(F.col("line"), F.lit(" "), F.lit(""))) + 1
    counted = lines.withColumn("n", n)
    keyed = counted.select(
        F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"),
        F.struct(F.col("id").isNotNull().alias("known"), "id", "th", "no", "n", half_keys(F.col("line"), F.col("n")).alias("halves")).alias("x"),
    )
    best = keyed.groupBy("h1", "h2").agg(F.min("x").alias("x"))
    return best.select("h1", "h2", F.struct("x.known", "x.id", "x.th", "x.no").alias("rank"), "x.n", "x.halves")


def shared_halves(lines: DataFrame) -> DataFrame:
    """h1, h2, base, side (0: the first half is shared) and key of the halves that another line has too."""
    each = lines.filter("halves IS NOT NULL").select("h1", "h2", "n", F.posexplode("halves").alias("k", "key")).filter("key IS NOT NULL")
    return shared_only(each.select("h1", "h2", (F.col("n") - F.shiftright("k", 1)).alias("base"), F.col("k").bitwiseAND(1).alias("side"), "key"))


def shared_only(keys: DataFrame) -> DataFrame:
    """Rows whose key another line has too."""
    return keys.join(keys.groupBy("key").count().filter("count > 1").select("key"), "key")


def quarter_keys(found: DataFrame) -> DataFrame:
    """found (h1, h2, line, n, base, side, key) with the range [lo, hi] of places the edit may be at, cut
    in two: lo, hi, and key of the part that is then shared besides."""
    m = F.expr("base div 2").cast("int")
    # places of the edit in the shorter line, as gaps: [m, base] or [0, m]
    lo, hi = F.when(F.col("side") == 0, m).otherwise(F.lit(0)), F.when(F.col("side") == 0, F.col("base")).otherwise(m)
    mid = ((lo + hi) / 2).cast("int")
    # the edit is at or after mid: words before mid are shared; or before it: words from mid on, counted from the end
    late = F.struct(mid.alias("lo"), hi.alias("hi"), F.xxhash64("key", F.lit(0), _first(F.col("line"), mid)).alias("key"))
    early = F.struct(lo.alias("lo"), mid.alias("hi"), F.xxhash64("key", F.lit(1), _first(F.col("line"), mid - F.col("base"))).alias("key"))
    return found.select("h1", "h2", "base", F.explode(F.array(late, early)).alias("s")).select("h1", "h2", "base", "s.lo", "s.hi", "s.key")


def variant_keys(found: DataFrame) -> DataFrame:
    """found (h1, h2, rank, line, n, base, lo, hi, key) to (variant, h1, h2, rank): deletions and gaps at lo..hi."""
    wh = F.transform(F.split("line", " "), lambda x: F.xxhash64(x))
    blocks = F.sequence(F.lit(0), F.floor(F.col("n") / BLOCK).cast("int"))
    hashed = found.withColumns({"wh": wh}).withColumns(
        {
            "ahead": F.transform(blocks, lambda b: F.xxhash64(F.slice("wh", F.lit(1), b * BLOCK))),
            "back": F.transform(blocks, lambda b: F.xxhash64(F.slice("wh", F.col("n") - b * BLOCK + 1, b * BLOCK))),
        }
    )

    def key(i: Column, skip: int, total: Column) -> Column:
        """Hash of the first i words and of those after i + skip."""
        rest = F.col("n") - i - skip
        a, b = F.floor(i / BLOCK).cast("int"), F.floor(rest / BLOCK).cast("int")
        return F.xxhash64(
            "key", total, i, F.element_at("ahead", a + 1), F.slice("wh", a * BLOCK + 1, i - a * BLOCK), F.element_at("back", b + 1), F.slice("wh", i + skip + 1, rest - b * BLOCK)
        )

    n = F.col("n")
    deleted = F.transform(F.sequence("lo", F.least(F.col("hi"), n - 1)), lambda i: key(i, 1, n - 1))
    gaps = F.when(n == F.col("base"), F.transform(F.sequence("lo", "hi"), lambda i: key(i, 0, n))).otherwise(F.array().cast("array<bigint>"))
    # in a line as long as the base the edit replaces word i: i is at most n - 1
    return hashed.select("h1", "h2", "rank", F.explode(F.concat(F.when(F.col("lo") <= n - 1, deleted).otherwise(F.array().cast("array<bigint>")), gaps)).alias("variant"))


def within_one_edit(a: Column, b: Column) -> Column:
    """Whether two arrays of words are at most one word edit apart."""
    short, long = F.when(F.size(a) <= F.size(b), a).otherwise(b), F.when(F.size(a) <= F.size(b), b).otherwise(a)
    n, more = F.size(short), F.size(long) - F.size(short)
    differs = F.filter(F.sequence(F.lit(1), n), lambda i: F.get(short, i - 1) != F.get(long, i - 1))
    p = F.when(F.size(differs) > 0, F.get(differs, F.lit(0)) - 1).otherwise(n)  # words in front that agree
    rest = F.slice(short, p + F.when(more == 1, F.lit(1)).otherwise(F.lit(2)), F.greatest(n - p, F.lit(0)))
    return (more <= 1) & ((F.size(differs) == 0) | (rest == F.slice(long, p + 2, F.greatest(n + more - p - 1, F.lit(0)))))


def document_key(frame: DataFrame, id_: str = "id", th: str = "th") -> list[Column]:
    """Columns i, z, th that tell documents apart and can be joined on, null ids included."""
    return [F.coalesce(F.col(id_), F.lit(0)).alias("i"), F.col(id_).isNull().alias("z"), F.col(th).alias("th")]


def with_words(found: DataFrame, docs: DataFrame) -> DataFrame:
    """found (rank and more, one row a line) with line, its words, from docs (id, th, text). A text is cut once for all its lines."""
    per = found.select(*document_key(found, "rank.id", "rank.th"), F.struct(*found.columns).alias("x")).groupBy("i", "z", "th").agg(F.collect_list("x").alias("xs"))
    joined = per.join(docs.select(*document_key(docs), "text"), ["i", "z", "th"]).select("xs", F.split("text", "\n").alias("lines"))
    each = joined.select(F.explode(F.transform("xs", lambda x: F.struct(x.alias("x"), F.get(F.col("lines"), x["rank"]["no"]).alias("l")))).alias("y"))
    return each.select("y.x.*", words_text(F.col("y.l")).alias("line"))


def near_copies(lines: DataFrame, docs: DataFrame) -> DataFrame:
    """h1, h2 of the distinct lines that are one edit from an earlier one, and the rank of one such line."""
    halves = materialize(shared_halves(lines), "lines-halves")
    chosen = lines.select("h1", "h2", "rank", "n").join(halves.select("h1", "h2").distinct(), ["h1", "h2"])
    # a row that repeats id and text brings its lines twice
    texts = materialize(with_words(chosen, docs).dropDuplicates(["h1", "h2"]), "lines-words")
    quarters = materialize(shared_only(quarter_keys(texts.join(halves, ["h1", "h2"]))).distinct(), "lines-quarters")
    variants = materialize(variant_keys(texts.join(quarters, ["h1", "h2"])).distinct(), "lines-variants")
    groups = variants.groupBy("variant").agg(F.min("rank").alias("first"), F.count("*").alias("n")).filter("n > 1").select("variant", "first")
    pairs = variants.join(groups, "variant").filter("rank <> first").select("h1", "h2", "first").distinct()
    w = F.split("line", " ")
    both = pairs.join(texts.select("h1", "h2", w.alias("w")), ["h1", "h2"]).join(texts.select(F.col("rank").alias("first"), w.alias("v")), "first")
    near = materialize(both.filter(within_one_edit(F.col("w"), F.col("v"))).groupBy("h1", "h2").agg(F.min("first").alias("near")), "lines-near")
    forget(halves, texts, quarters, variants)
    return near


def kept_lines(docs: DataFrame) -> DataFrame:
    """id, th and kept: the places of the lines with words that stay, of docs (id, th, text)."""
    lines = materialize(distinct_lines(docs), "lines")
    stay = lines.select("h1", "h2", "rank").join(near_copies(lines, docs), ["h1", "h2"], "left_anti")
    kept = materialize(stay.groupBy(F.col("rank.id").alias("id"), F.col("rank.th").alias("th")).agg(F.collect_list("rank.no").alias("kept")), "lines-kept")
    forget(lines)
    return kept


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", out_col: str = "clean_text") -> DataFrame:
    """Add out_col (the text without the lines that go), n_lines, n_kept and n_blank.

    n_lines counts lines with words; lines without words always stay. Null
    text counts as empty. Of rows that repeat both id and text all keep the
    same lines: they are one document seen twice. Existing columns with the
    new names are replaced; all others stay. An empty table gives an empty table.

    A document's lines are cut at newlines only. A document and its kept lines
    meet by id and text hash, so that no line however frequent is joined by
    its content.
    """
    names = {out_col, "n_lines", "n_kept", "n_blank"}
    keep = [c for c in df.columns if c not in names]
    text = whole_text(text_col)
    keyed = df.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))
    kept = kept_lines(keyed.select("id", "th", "text"))
    joined = keyed.select(*document_key(keyed), "row", "text").join(kept.select(*document_key(kept), "kept"), ["i", "z", "th"], "left")
    lines = joined.select("row", F.split("text", "\n").alias("lines"), F.coalesce("kept", F.array().cast("array<int>")).alias("kept"))
    blank = lambda x: ~x.rlike("[^\\x20\\x09-\\x0D]")
    stays = F.map_from_arrays("kept", "kept")
    cut = lines.withColumn("stays", stays).withColumn("blanks", F.size(F.filter("lines", blank)))
    out = F.array_join(F.filter("lines", lambda x, i: blank(x) | F.map_contains_key("stays", i)), "\n")
    return cut.select(
        *[F.col("row").getField(c).alias(c) for c in keep],
        out.alias(out_col),
        (F.size("lines") - F.col("blanks")).cast("long").alias("n_lines"),
        F.size("kept").cast("long").alias("n_kept"),
        F.col("blanks").cast("long").alias("n_blank"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup(docs).select("doc_id", "n_lines", "n_kept", "n_blank", F.sha2(F.col("clean_text").cast("binary"), 256).alias("clean_sha256"))


ORACLE_SQL = rf"""
WITH lines AS (
  SELECT doc_id, no, l, regexp_extract_all(l, '[^\x20\x09-\x0D]+') AS w
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS l, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS no FROM documents)
), firsts AS (
  SELECT w, doc_id, no, row_number() OVER (ORDER BY doc_id NULLS FIRST, no) AS r
  FROM (SELECT w, doc_id, no, row_number() OVER (PARTITION BY w ORDER BY doc_id NULLS FIRST, no) AS c FROM lines WHERE len(w) > 0) WHERE c = 1
), variants AS (
  SELECT r, w, list_concat(list_slice(w, 1, i - 1), list_slice(w, i + 1, len(w))) AS v
  FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM firsts WHERE len(w) >= {MIN_WORDS})
  UNION ALL SELECT r, w, w FROM firsts WHERE len(w) >= {MIN_WORDS}
), pairs AS (
  SELECT DISTINCT a.r AS r, a.w AS aw, b.w AS bw FROM variants a JOIN variants b ON a.v = b.v AND b.r < a.r
), prefixes AS (
  SELECT r, aw, bw, coalesce(list_position(list_transform(range(1, least(len(aw), len(bw)) + 1), lambda i: aw[i] <> bw[i]), true) - 1, least(len(aw), len(bw))) AS p FROM pairs
), near AS (
  SELECT DISTINCT r FROM prefixes
  WHERE CASE WHEN len(aw) = len(bw) THEN list_slice(aw, p + 2, len(aw)) = list_slice(bw, p + 2, len(bw))
             WHEN len(aw) = len(bw) + 1 THEN list_slice(aw, p + 2, len(aw)) = list_slice(bw, p + 1, len(bw))
             WHEN len(aw) + 1 = len(bw) THEN list_slice(aw, p + 1, len(aw)) = list_slice(bw, p + 2, len(bw)) ELSE false END
), stay AS (
  SELECT doc_id, no FROM firsts WHERE r NOT IN (SELECT r FROM near)
), marked AS (
  SELECT l.doc_id, l.no, l.l, len(l.w) = 0 AS blank, s.no IS NOT NULL AS kept
  FROM lines l LEFT JOIN stay s ON l.doc_id IS NOT DISTINCT FROM s.doc_id AND l.no = s.no
)
SELECT doc_id, count(*) FILTER (WHERE NOT blank) AS n_lines, count(*) FILTER (WHERE kept) AS n_kept, count(*) FILTER (WHERE blank) AS n_blank,
       sha256(coalesce(string_agg(l, chr(10) ORDER BY no) FILTER (WHERE blank OR kept), '')) AS clean_sha256
FROM marked GROUP BY doc_id
"""
