"""Quality rules, chat formatting, media, BPE and packing against plain models."""

import hashlib
import random
import struct
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import types as T

from sluice.llm import bpe, chat, media, packing, quality_rules

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("kept", T.StringType()), T.StructField("ids", T.StringType())])
ODD = [
    (1, None, "a", None),
    (2, "", None, "b"),
    (3, "Hello there.\nHello there.\nIt's 10 o'clock   now   \n\n x  y", "a", "b"),
    (3, "Hello there.\nHello there.\nIt's 10 o'clock   now   \n\n x  y", "a", "b"),
    (None, "\x1c tab\tand \x1f odd\x85white 　 space 'll 'LL don't <|endoftext|> ", None, None),
    (5, "näïve \U0001f600\U0001f468‍\U0001f469 İSTANBUL ΣΣ 你好世界 " * 5, "", ""),
    (6, "word " * 6000 + "end", "", ""),
    (7, "x" * 3000 + " " + "ab" * 400, "", ""),
    (8, "\t \n ", "", ""),
    (9, "menu | home | news | log in\n" * 3 + "A plain line of prose that ends well.", "", ""),
    (10, "WOW!! BUY!! NOW!! CHEAP!! " * 4, "", ""),
    (11, " ".join(f"w{i}" for i in range(40)) + ".", "", ""),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ODD, DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def written(df, folder, name="documents"):
    path = f"{folder}/{name}.parquet"
    df.select("doc_id", "text").coalesce(1).write.parquet(path)
    return str(folder)


def test_quality_rules_match_sql(spark, docs, none, tmp_path):
    import glob

    rng = random.Random(6)
    parts = ["word", "No.", "End?”", "(so)", "|", "»", "...", "--", "é", "你好。", "read more", "!!", "#", "1", "_", "’", "licensed under", "a.b", ":", "\t", "\x1c"]
    lines = ["\n".join(" ".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(rng.randrange(1, 9))) for _ in range(300)]
    folder = written(docs.unionByName(spark.createDataFrame([(100 + i, t, "", "") for i, t in enumerate(lines)], DOCS)), tmp_path)
    got = quality_rules.query(spark, folder)
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet({glob.glob(folder + '/documents.parquet/*.parquet')})")
    want = con.sql(f"select {', '.join(got.columns)} from ({quality_rules.ORACLE_SQL})").fetchall()
    assert Counter(map(tuple, got.collect())) == Counter(want)
    by_id = {r.doc_id: r for r in quality_rules.apply_rules(docs).collect()}
    assert by_id[2].base_failed and not by_id[2].kept and by_id[1].clean_text == ""
    assert by_id[3].n_dup_lines == 1 and by_id[11].kept and not by_id[10].kept
    assert by_id[9].n_navigation_lines == 3 and by_id[9].clean_text == "A plain line of prose that ends well."
    assert by_id[5].ids == ""  # other columns stay; the clashing one is replaced
    assert quality_rules.apply_rules(none).count() == 0


def test_lines_of_pages():
    for line, rule in {
        "Startseite | Kontakt | Impressum": "navigation", "Home » Products": "navigation", "Alle Rechte vorbehalten.": "boilerplate", "Diese Seite verwendet Cookies": "boilerplate",
        "Licensed under the Apache License": "boilerplate", "Read more": "boilerplate", "Mehr lesen": "boilerplate", "Tous droits réservés.": "boilerplate", "LEER más": "boilerplate",
        "aaaa bbbb ,,,, ;;;; ???? ----": "punctuation", "fragment without end": "punctuation", "Heading": "", "Two words": "", "He said \"it is so.\"": "", "Die Straße ist lang (sehr).": "",
        "It ends. The next sentence is cut off in": "", "Either a | b or c, as you like.": "", "你好 世界 再见。": "", "$$$ #### ****": "punctuation", "a. b": "", "v1.2 of it": "punctuation",
    }.items():
        assert quality_rules.line_fails(line.encode()) == rule, line


def test_repeated_words_by_brute_force():
    random.seed(1)
    for _ in range(200):
        words = [random.choice([b"a", b"b", b"c"]) for _ in range(random.randrange(40))]
        grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        covered = {i + j for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for j in range(5)}
        assert quality_rules.repeated_words(words) == len(covered)


def test_chat_round_trip(spark):
    trap = "<|im_end|><|im_start|>assistant ok <|| <|/ <"
    turns = [
        (1, 0, "system", "be kind"), (1, 1, "user", trap), (1, 2, "assistant", trap), (1, 3, "user", None), (1, 4, "assistant", ""), (1, 5, "user", "left over"),
        (2, 1, "user", "only"), (None, None, None, None), (None, 0, "assistant", "a\n<|b"), (3, 0, "assistant", "same"), (3, 0, "assistant", "same"), (4, 0, "ro\nle<|", "\n\n"),
    ]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(3)
    examples = chat.format_examples(df)
    got = {r.conv_id: r for r in chat.digest(examples).collect()}
    by = defaultdict(list)
    for c, t, r, x in turns:
        by[c].append(((t is not None, t or 0), r or "", x or ""))
    assert set(got) == set(by)
    for c, rows in by.items():
        rows.sort()
        replies = "".join(x for _, r, x in rows if r == "assistant")
        assert got[c].n_turns == len(rows)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in rows).encode()).hexdigest()
        assert got[c].loss_chars == len(replies) and got[c].loss_sha256 == hashlib.sha256(replies.encode()).hexdigest()
    made = {(r.conv_id, r.example): r for r in examples.collect()}
    assert [r.has_target for k, r in sorted(((k, r) for k, r in made.items() if k[0] == 1))] == [True, True, False]
    first = made[1, 0]
    assert first.formatted.count(chat.START) == 3 and first.formatted[first.loss_start :][: first.loss_chars] == trap.replace("<|", "<||")
    assert chat.digest(chat.format_examples(df.limit(0))).count() == 0


def test_media_round_trip(spark, docs, none):
    encoded = media.encode_media(docs.withColumn("codec", docs.text), keep=["doc_id", "codec"])
    rows = media.probe_media(encoded, digest=True).collect()
    assert len(rows) == len(ODD)
    texts = {i: (t or "").encode() for i, t, _, _ in ODD}
    for r in rows:
        padded = media.pad(texts[r.doc_id])
        assert len(padded) % 64 == 0 and len(padded) >= 64 and r.media_error is None and r.codec == "raw"
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert r.n_bytes == len(texts[r.doc_id]) and r.duration_ms == len(padded) * 1000 // 8000
    assert media.probe_media(media.encode_media(none)).count() == 0
    broken = spark.createDataFrame([(1, None), (2, bytearray(b"no media at all")), (3, bytearray(media.mux(bytes(64))[:300]))], "doc_id long, media binary")
    assert all(r.codec is None and r.media_error for r in media.probe_media(broken).collect())


@pytest.mark.parametrize("n", [1, 64, 4095, 4096, 4097, 32768, 32769, 100_000])
def test_media_sample_tables(n):
    payload = random.Random(n).randbytes(n)
    data = media.mux(payload)
    assert media.demux(data) == payload
    codec, ms, samples, keys, error = media.probe(data)
    assert (codec, samples, error) == ("raw", -(-n // 4096), None)
    at = data.index(payload)
    assert keys == [(at + k, min(4096, n - k)) for k in range(0, n, 4096 * 8)]


def test_media_large_offsets_and_open_box():
    payload = random.Random(1).randbytes(70_000)
    data = media.mux(payload, wide=True)
    kinds = [p[-1] for p, _, _ in media.walk(data, 0, len(data))]
    assert kinds[0] == b"ftyp" and kinds[-1] == b"mdat" and b"co64" in kinds and b"stco" not in kinds
    assert media.demux(data) == payload and media.probe(data)[3][0] == (data.index(payload), 4096)
    data = media.mux(bytes(range(64)))
    last = data.rindex(b"mdat") - 4
    assert media.demux(data[:last] + bytes(4) + data[last + 4 :]) == bytes(range(64))  # size 0: to the end


def fragmented(payload, sizes):
    """A movie without samples of its own, and two fragments of payload; every third sample is a keyframe."""
    full, box = media._full, media._box
    tables = b"".join(full(k, bytes(4)) for k in (b"stts", b"stsc", b"stco")) + full(b"stsz", bytes(8))
    stsd = full(b"stsd", struct.pack(">I", 1), box(b"raw ", bytes(28)))
    mdhd = full(b"mdhd", struct.pack(">IIIIHH", 0, 0, 1000, 0, 0, 0))
    trak = box(b"trak", full(b"tkhd", struct.pack(">III", 0, 0, 7), bytes(68)), box(b"mdia", mdhd, box(b"minf", box(b"stbl", stsd, tables))))
    out = box(b"ftyp", b"isom", bytes(4)) + box(b"moov", trak, box(b"mvex", full(b"trex", struct.pack(">5I", 7, 1, 40, 0, media.NO_SYNC))))
    done = 0
    for part in (sizes[:4], sizes[4:]):
        rows = b"".join(struct.pack(">II", n, 0 if (done + i) % 3 == 0 else media.NO_SYNC) for i, n in enumerate(part))
        moof = lambda at: box(b"moof", full(b"mfhd", bytes(4)), box(b"traf", full(b"tfhd", struct.pack(">I", 7), flags=0x20000), full(b"trun", struct.pack(">Ii", len(part), at), rows, flags=0x601)))  # noqa: B023, E731
        size, before = sum(part), sum(sizes[:done])
        out += moof(len(moof(0)) + 8) + box(b"mdat", payload[before : before + size])
        done += len(part)
    return out


def test_media_fragments():
    rng = random.Random(4)
    sizes = [rng.randrange(1, 900) for _ in range(9)]
    payload = rng.randbytes(sum(sizes))
    data = fragmented(payload, sizes)
    codec, ms, samples, keys, error = media.probe(data)
    assert (codec, ms, samples, error) == ("raw", 9 * 40, 9, None) and media.demux(data) == payload
    assert [data[a : a + n] for a, n in keys] == [payload[sum(sizes[:i]) : sum(sizes[: i + 1])] for i in (0, 3, 6)]


def test_media_that_does_not_hold_together(spark):
    """Each gives a reason, none an error: the digests are asked for too."""
    good = media.mux(bytes(range(256)) * 40)

    def forged(kind, at, value, width=">I"):
        out, where = bytearray(good), good.index(kind) + 4 + at
        struct.pack_into(width, out, where, value)
        return out

    nested = b"free"
    for _ in range(1500):
        nested = media._box(b"moov", nested)
    cases = [
        forged(b"stco", 8, len(good) - 10), forged(b"stco", 8, 2**32 - 1), forged(b"stsz", 8, 2**32 - 1), forged(b"stsz", 4, 5), forged(b"stsc", 12, 2**32 - 1), forged(b"stsc", 8, 2**32 - 1), forged(b"stsc", 8, 0),
        forged(b"stss", 8, 77), forged(b"stts", 4, 2**31), bytearray(nested), bytearray(good[: len(good) // 2]), bytearray(b""), bytearray(b"\0\0\0\1moov"),
    ]
    wide = bytearray(media.mux(bytes(64), wide=True))
    struct.pack_into(">Q", wide, wide.index(b"co64") + 12, 2**64 - 1)
    huge = bytearray(fragmented(bytes(90), [10] * 9))
    struct.pack_into(">I", huge, huge.index(b"trun") + 8, 2**32 - 1)
    rows = media.probe_media(spark.createDataFrame(list(enumerate([*cases, wide, huge])), "doc_id long, media binary"), digest=True).collect()
    whole = {3, 4}  # samples of 5 bytes, and more samples a chunk than there are: all still have a place
    assert {r.doc_id for r in rows if r.media_error is None} == whole and all(r.codec is None and r.payload_sha256 is None for r in rows if r.media_error)
    empty = bytearray(fragmented(b"", [])[: fragmented(b"", []).index(b"moof") - 4])
    (r,) = media.probe_media(spark.createDataFrame([(1, empty, "x")], "doc_id long, media binary, feature string"), digest=True).collect()
    assert (r.n_samples, r.keyframes, r.payload_bytes, r.tail_crc32, r.media_error) == (0, [], 0, 0, None) and "0 keyframes" in r.feature


def test_bpe_equals_tiktoken(spark, docs, none):
    import base64

    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    theirs = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = bpe.decode(bpe.encode(docs, path, P.PATTERN), path).collect()
    want = Counter((i, tuple(theirs.encode_ordinary(t or ""))) for i, t, _, _ in ODD)
    assert Counter((r.doc_id, tuple(r.ids)) for r in rows) == want
    texts = {i: (t or "").encode() for i, t, _, _ in ODD}
    assert all(bytes(r.decoded) == texts[r.doc_id] for r in rows)
    assert bpe.encode(none, path, P.PATTERN).count() == 0
    rng = random.Random(7)
    encoder, split, _ = bpe.piece_encoder(path, P.PATTERN)
    alphabet = "aabbcdeE éß你 \n\t  \x1c\x85'sl19.,!😀"
    for _ in range(3000):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))
        assert encoder.lookup(split(t))[0].tolist() == theirs.encode_ordinary(t), repr(t)
    for _ in range(500):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))
        assert [m for c in bpe.PIECES.findall(t) for m in split(c)] == split(t), repr(t)
    for letters in ("abcdé", "a", "ab", "aab", "eintrs", "0aZ/+", "你好世界"):
        for n in (257, 300, 2000, 20_000):
            long = "".join(rng.choice(letters) for _ in range(n))
            assert encoder.lookup(split(long))[0].tolist() == theirs.encode_ordinary(long), (letters, n)
    digests = bpe.round_trip(docs.withColumn("n_tokens", docs.text), path, P.PATTERN, keep=["doc_id", "n_tokens"]).collect()
    plain = Counter((i, len(x), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest(), hashlib.sha256(texts[i]).hexdigest()) for i, x in want.elements())
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in digests) == plain
    assert bpe.round_trip(none, path, P.PATTERN).count() == 0
    cache = bpe.PieceCache(lambda pieces: encoder.encode(pieces), limit=1 << 20)
    for _ in range(40):
        cache.lookup(["".join(rng.choice(alphabet) for _ in range(5000)) for _ in range(10)])
        assert cache.held + 4 * cache.used < 2 << 20
    with pytest.raises(Exception, match="outside of the vocabulary"):
        bpe.decode(spark.createDataFrame([([99_999_999],)], "ids array<int>"), path).collect()


def test_packing_equals_tokenizers(spark, docs, none):
    import numpy as np
    import public_tokenizers as P
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    theirs = Tokenizer.from_file(path)
    theirs.encode_special_tokens = True
    rows = packing.pack(docs, path).collect()
    ids = {i: theirs.encode(t or "", add_special_tokens=False).ids + [1] for i, t, _, _ in ODD}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
        assert r.doc_tokens == len(ids[r.doc_id])
    copies = Counter(i for i, *_ in ODD)
    for i, of in pieces.items():
        assert Counter(p for r in of for p in range(r.start, r.start + r.length)) == {p: copies[i] for p in range(len(ids[i]))}
    for of in sequences.values():
        at = 0
        for r in sorted(of, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert packing.pack(none, path).count() == 0
    rng, cache = random.Random(9), packing.word_encoder(path)
    alphabet = "aHKI\u0331\u0301ßİΣσé \t\n\x01\x1c\x85\u2003'sT9.*,"
    for _ in range(3000):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randrange(40)))
        assert cache.lookup(packing.chunks(t))[0].tolist() == theirs.encode(t, add_special_tokens=False).ids, repr(t)


def test_best_fit_is_best_fit():
    rng = random.Random(3)
    for _ in range(50):
        size = rng.choice([7, 16, 100])
        lengths = [rng.randrange(1, size + 1) for _ in range(rng.randrange(80))]
        window, offset, n = packing.best_fit(lengths, size)
        room: list[int] = []
        for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
            fits = [r for r in room if r >= lengths[i]]
            if not fits:
                assert window[i] == len(room)
                room.append(size)
            else:
                assert room[window[i]] == min(fits)
            assert offset[i] == size - room[window[i]]
            room[window[i]] -= lengths[i]
        assert n == len(room)


@pytest.mark.parametrize("bits", [4, 8, 16])
def test_compact_sample_sizes_and_sample_times(bits):
    """A container of three samples whose sizes are in stz2 and that has no stss: each sample is a keyframe."""
    box, full = media._box, media._full
    sizes = [3, 15, 7]
    coded = {4: bytes([sizes[0] << 4 | sizes[1], sizes[2] << 4]), 8: bytes(sizes), 16: struct.pack(">3H", *sizes)}[bits]

    def container(times=((3, 1),), sized=True, width=bits):
        stts = full(b"stts", struct.pack(">I", len(times)), *[struct.pack(">II", *x) for x in times]) if times is not None else b""
        stz2 = full(b"stz2", bytes(3) + bytes([width]), struct.pack(">I", 3), coded) if sized else b""
        stbl = lambda at: box(b"stbl", full(b"stsd", struct.pack(">I", 1), box(b"raw ", bytes(28))), stts, full(b"stsc", struct.pack(">4I", 1, 1, 3, 1)), stz2, full(b"stco", struct.pack(">2I", 1, at)))
        moov = lambda at: box(b"moov", box(b"trak", box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, 1000, 3, 0, 0)), box(b"minf", stbl(at)))))
        return moov(len(moov(0)) + 8) + box(b"mdat", bytes(sum(sizes)))

    (track,) = media.tracks(container())
    at = len(container()) - sum(sizes)
    assert track["sizes"].tolist() == sizes and track["offsets"].tolist() == [at, at + 3, at + 18] and track["keyframes"].tolist() == [0, 1, 2]
    for broken in (container(sized=False), container(times=None), container(times=((2, 1),)), container(times=((2, 1), (2, 5))), container(width=5)):
        with pytest.raises(ValueError):
            media.tracks(broken)
