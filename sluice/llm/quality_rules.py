"""Quality rules, line first.

Every line is judged on its own. Lines that fail are removed; a document is then
rejected if it is malformed as a whole or if the removed lines held too much of
it. A line fails the first of these rules that holds:

- punctuation: too many symbols or "!!";
- navigation: a bar or trail of short entries, told by its separators;
- boilerplate: a short line with a phrase of page furniture or of a licence, in
  English, German, French or Spanish;
- punctuation again: too many words without a letter or digit, or some words in
  which no sentence ends. Ends may be followed by quotes and brackets. Lines of
  one or two words may be headings and stay.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import map_texts, table

#: Characters that mark up rather than say something.
SYMBOLS = "#*$%&|<>"
#: What a line of a navigation bar is cut by.
SEPARATORS = ("|", "»", "›", "•", "·")
#: Phrases of page furniture and licences, compared in lower case (ASCII letters only).
BOILERPLATE = (
    "all rights reserved", "cookie policy", "privacy policy", "terms of service", "terms of use", "enable javascript", "click here", "lorem ipsum", "sign in", "log in", "subscribe to",
    "read more", "uses cookies", "use cookies", "licensed under", "released under the", "creative commons",
    "alle rechte vorbehalten", "verwendet cookies", "verwenden cookies", "datenschutzerkl", "mehr lesen", "weiterlesen", "hier klicken", "nutzungsbedingungen", "lizenziert unter",
    "tous droits r", "utilise des cookies", "lire la suite", "mentions l\u00e9gales", "cliquez ici", "se connecter", "conditions d'utilisation", "sous licence",
    "todos los derechos reservados", "utiliza cookies", "leer m\u00e1s", "aviso legal", "haga clic", "iniciar sesi\u00f3n", "condiciones de uso", "bajo licencia",
)
#: A line with a boilerplate phrase fails only if it has at most this many words.
BOILERPLATE_WORDS = 12
#: More separators than this many a 100 words (and at least MIN_SEPARATORS) are navigation.
SEPARATORS_PER_100 = 20
MIN_SEPARATORS = 3
#: A line of at most this many words that ends no sentence is navigation with one separator.
TRAIL_WORDS = 10
#: More words without a letter or digit than this many a 100 fail the punctuation rule.
BARE_PER_100 = 30
#: A line of so many words in which no sentence ends is a fragment.
FRAGMENT_WORDS = 3
#: What ends a sentence, and what may follow it.
ENDS, CLOSERS = ".!?\u2026:;\u3002\uff01\uff1f", "\"')]}\u00bb\u201d\u2019\u203a\u201c\u00ab*_"
#: More symbols than this many a 100 words fail the punctuation rule.
SYMBOLS_PER_100 = 30
#: So many "!!" a 100 words fail it as well.
SHOUTS_PER_100 = 30
#: A document that loses more than this share (percent) of its words' characters goes.
MAX_LOST = 50
MIN_WORDS = 10
MAX_REPEATED = 20
WINDOW = 5

#: ASCII but letters and digits.
_DROP = bytes(c for c in range(128) if not chr(c).isalnum())
_PHRASES = tuple(p.encode() for p in BOILERPLATE)
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def word_chars(data: bytes) -> int:
    """Code points in words: all but ASCII white space and UTF-8 continuation bytes."""
    return len(data) - sum(data.count(c) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")) - _continuations(data)


def _continuations(data: bytes) -> int:
    return 0 if data.isascii() else len(data) - len(data.decode("utf-8", "replace"))


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words within a window of words that occurs twice or more in the text."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    grams = list(zip(*[words[i : n + i] for i in range(window)], strict=True))
    if len(set(grams)) == n:
        return 0
    first: dict = {}
    twice = set()
    for i, g in enumerate(grams):
        if first.setdefault(g, i) != i:
            twice.add(g)
    count, end = 0, 0
    for i, g in enumerate(grams):
        if g in twice:
            count += i + window - max(i, end)
            end = i + window
    return count


_SENTENCE = re.compile(f"[{re.escape(ENDS)}][{re.escape(CLOSERS)}]*(?=[\\x20\\x09-\\x0D]|\\Z)")
_END = re.compile(f"[{re.escape(ENDS)}][{re.escape(CLOSERS)}]*[\\x20\\x09-\\x0D]*\\Z")
_SAYS = re.compile(r"[^\W_]")


def line_fails(line: bytes) -> str:
    """The rule that a line with words fails, or an empty string."""
    words = line.split()
    n = len(words)
    if 100 * sum(line.count(c) for c in (b"#", b"*", b"$", b"%", b"&", b"<", b">")) > SYMBOLS_PER_100 * n or 100 * line.count(b"!!") > SHOUTS_PER_100 * n:
        return "punctuation"
    marks = sum(line.count(s.encode()) for s in SEPARATORS)
    if marks:
        if marks >= MIN_SEPARATORS and 100 * marks > SEPARATORS_PER_100 * n:
            return "navigation"
        if n <= TRAIL_WORDS and not _END.search(line.decode("utf-8", "replace")):
            return "navigation"
    if n <= BOILERPLATE_WORDS:
        low = line.translate(_LOWER)
        if any(p in low for p in _PHRASES):
            return "boilerplate"
    if line.isascii():  # then a word says something if one of its bytes is a letter or digit
        bare = sum(not w.isalnum() and not w.translate(None, _DROP) for w in words)
    else:
        bare = sum(not _SAYS.search(w.decode("utf-8", "replace")) for w in words)
    if bare > 1 and 100 * bare > BARE_PER_100 * n:
        return "punctuation"
    return "punctuation" if n >= FRAGMENT_WORDS and not _SENTENCE.search(line.decode("utf-8", "replace")) else ""


def judge(text: str) -> tuple:
    """Counts and verdict for one text, and the text without failed lines."""
    data = text.encode("utf-8", "replace")
    words = data.split()
    n = len(words)
    chars = word_chars(data)
    symbols = sum(data.count(c.encode()) for c in SYMBOLS)
    repeated = repeated_words(words)
    seen: set[bytes] = set()
    duplicates, lost = 0, 0
    failed = {"punctuation": 0, "navigation": 0, "boilerplate": 0}
    kept_lines = []
    for line in data.split(b"\n"):
        if line.strip():
            if line in seen:
                duplicates += 1
            else:
                seen.add(line)
            if why := line_fails(line):
                failed[why] += 1
                lost += word_chars(line)
                continue
        kept_lines.append(line)
    base_failed = n < MIN_WORDS or 100 * repeated > MAX_REPEATED * n
    kept = not base_failed and 100 * lost <= MAX_LOST * chars
    return n, chars, symbols, duplicates, repeated, base_failed, kept, failed["punctuation"], failed["navigation"], failed["boilerplate"], lost, b"\n".join(kept_lines).decode("utf-8", "replace")


FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("word_chars", T.LongType()),
    T.StructField("n_symbols", T.LongType()),
    T.StructField("n_dup_lines", T.LongType()),
    T.StructField("n_repeat_words", T.LongType()),
    T.StructField("base_failed", T.BooleanType()),
    T.StructField("kept", T.BooleanType()),
    T.StructField("n_punctuation_lines", T.LongType()),
    T.StructField("n_navigation_lines", T.LongType()),
    T.StructField("n_boilerplate_lines", T.LongType()),
    T.StructField("lost_chars", T.LongType()),
    T.StructField("clean_text", T.StringType()),
]


def apply_rules(df: DataFrame, text_col: str = "text", keep: list[str] | None = None, with_text: bool = True) -> DataFrame:
    """Judge every document; one output row per input row, in one pass, no shuffle.

    keep: columns that stay (default: all but those the operator makes, which
    replace columns of the same name). Null or empty text: no words, so
    base_failed and not kept, clean_text empty. Repeated rows are judged alike.
    Lines without words neither fail nor count as duplicates and stay in place.
    An empty table gives an empty table. Cost is linear in the text.
    """
    keep = df.columns if keep is None else keep
    fields = FIELDS if with_text else FIELDS[:-1]

    def make():
        def compute(texts: list[str]) -> list:
            rows = [judge(t)[: len(fields)] for t in texts]
            return list(zip(*rows, strict=True))

        return compute

    return map_texts(df, text_col, keep, fields, make)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(table(spark, sf_dir, "documents"), keep=["doc_id"], with_text=False)


_ENDS_SQL, _CLOSERS_SQL = ENDS, CLOSERS.replace("]", "\\]").replace("'", "''")
_ENDS = rf"regexp_matches(l, '[{_ENDS_SQL}][{_CLOSERS_SQL}]*[\x20\x09-\x0D]*$')"
_BARE = r"len(list_filter(regexp_extract_all(l, '[^\x20\x09-\x0D]+'), lambda x: NOT regexp_matches(x, '[\pL\pN]')))"
_FAILS_BARE = f"(100 * {_BARE} > {BARE_PER_100} * nw AND {_BARE} > 1)"
_SENTENCE_SQL = rf"regexp_matches(l, '[{_ENDS_SQL}][{_CLOSERS_SQL}]*([\x20\x09-\x0D]|$)')"
_FAILS_PUNCTUATION = f"(100 * len(regexp_extract_all(l, '[#*$%&<>]')) > {SYMBOLS_PER_100} * nw OR 100 * len(regexp_extract_all(l, '!!')) > {SHOUTS_PER_100} * nw)"
_MARKS = f"len(regexp_extract_all(l, '[{''.join(SEPARATORS)}]'))"
_FAILS_NAVIGATION = f"(({_MARKS} >= {MIN_SEPARATORS} AND 100 * {_MARKS} > {SEPARATORS_PER_100} * nw) OR ({_MARKS} > 0 AND nw <= {TRAIL_WORDS} AND NOT {_ENDS}))"
_ASCII_LOWER = "translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_FAILS_BOILERPLATE = f"(nw <= {BOILERPLATE_WORDS} AND ({' OR '.join(f"contains({_ASCII_LOWER}, '{p.replace(chr(39), chr(39) * 2)}')" for p in BOILERPLATE)}))"

ORACLE_SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), words AS (
  SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM docs
), grams AS (
  SELECT rid, p, list_slice(w, p, p + {WINDOW - 1}) AS g
  FROM (SELECT rid, w, unnest(range(1, len(w) - {WINDOW - 2})) AS p FROM words WHERE len(w) >= {WINDOW})
), twice AS (
  SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, g) AS c FROM grams) WHERE c > 1
), repeats AS (
  SELECT rid, count(DISTINCT q) AS n_repeat_words
  FROM (SELECT rid, unnest(range(p, p + {WINDOW})) AS q FROM twice) GROUP BY rid
), lines AS (
  SELECT rid, k, l, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS nw
  FROM (SELECT rid, unnest(string_split(t, chr(10))) AS l, generate_subscripts(string_split(t, chr(10)), 1) AS k FROM docs)
), judged AS (
  SELECT rid, k, l, nw, row_number() OVER (PARTITION BY rid, l ORDER BY k) AS copy,
         CASE WHEN {_FAILS_PUNCTUATION} THEN 'p' WHEN {_FAILS_NAVIGATION} THEN 'n' WHEN {_FAILS_BOILERPLATE} THEN 'b' WHEN {_FAILS_BARE} OR (nw >= {FRAGMENT_WORDS} AND NOT {_SENTENCE_SQL}) THEN 'p' ELSE '' END AS why,
         length(regexp_replace(l, '[\x20\x09-\x0D]', '', 'g')) AS lc
  FROM lines WHERE nw > 0
), per_doc AS (
  SELECT rid, count(*) FILTER (WHERE copy > 1) AS n_dup_lines,
         count(*) FILTER (WHERE why = 'p') AS np, count(*) FILTER (WHERE why = 'n') AS nn, count(*) FILTER (WHERE why = 'b') AS nb,
         coalesce(sum(lc) FILTER (WHERE why <> ''), 0) AS lost
  FROM judged GROUP BY rid
), counted AS (
  SELECT doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         coalesce(np, 0) AS np, coalesce(nn, 0) AS nn, coalesce(nb, 0) AS nb, coalesce(lost, 0) AS lost
  FROM words LEFT JOIN per_doc USING (rid) LEFT JOIN repeats USING (rid)
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words) AS base_failed,
       (NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words) AND 100 * lost <= {MAX_LOST} * word_chars) AS kept,
       CAST(np AS BIGINT) AS n_punctuation_lines, CAST(nn AS BIGINT) AS n_navigation_lines, CAST(nb AS BIGINT) AS n_boilerplate_lines,
       CAST(lost AS BIGINT) AS lost_chars
FROM counted
"""
