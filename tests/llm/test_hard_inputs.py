"""Inputs that are hostile or lopsided: endless words and white space, repeated ids, clashing names, broken containers."""

from __future__ import annotations

import struct
import time
import zlib

import numpy as np
import pytest

from quillmesh.llm import induced, langid, media, mixing, packing, pii, repeats, separators, shingles, toxicity
from quillmesh.llm.tokens import Encoder


@pytest.mark.parametrize("text", [" " * 1_000_000, "\n" * 1_000_000, "a" + " \t" * 300_000 + "b"])
def test_white_space_without_end(spark, text):
    frame = spark.createDataFrame([(1, text), (2, "some words")], "doc_id bigint, text string")
    tokens = {i: len(Encoder()(t)) for i, t in ((1, text), (2, "some words"))}
    blocks, manifest = separators.write_stream(frame)
    counted = separators.count_tokens(blocks).join(manifest, ["shard", "ordinal"])
    assert {r.doc_id: r.n_tokens for r in counted.collect()} == tokens
    packed = packing.pack(frame).collect()
    assert {i: sum(r.length for r in packed if r.doc_id == i) for i in tokens} == {i: n + 1 for i, n in tokens.items()}


@pytest.mark.parametrize("text", ["x" * 1_000_000, "x1" * 500_000, "a@" * 500_000, "idiot proof " * 100_000, "é" * 1_000_000])
def test_words_without_end(text):
    automaton = toxicity.Lexicon({" idiot ": 4.0}, ("idiot proof",)).automaton()
    began = time.time()
    assert toxicity.evidence(*toxicity.fold(text + " idiot"), automaton) > 0
    assert time.time() - began < 5


def test_hidden_and_decorated_letters():
    for word in ("id‍iot", "id­iot", "ídiot", "ídiot", "𝐢𝐝𝐢𝐨𝐭", "ｉｄｉｏｔ", "ıdıоt", "1d10t"):
        assert toxicity.fold(word)[0] == " idiot "


@pytest.mark.parametrize("hot", [7, 8, 9, 11, 12])
def test_a_repeated_id_takes_no_language_away(spark, hot):
    rows = [(hot, f"the same words of one text again {k}", "en") for k in range(5000)] + [(100 + k, f"quelques mots de la langue {k}", "fr") for k in range(40)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    found = langid.learn(frame)
    held_out = zlib.crc32(str(hot).encode()) % 5 == 0
    assert list(found) == (["fr"] if held_out else ["fr", "en"]) and found == langid.learn(frame.repartition(7))


def test_a_repeated_id_trains_once(spark):
    rows = [(1, f"idiot {k}") for k in range(500)] + [(100 + k, f"idiot word {k}" if k % 9 == 0 else f"plain word {k}") for k in range(400)]
    labels = spark.createDataFrame([(i, int(i == 1 or (i - 100) % 9 == 0)) for i in {r[0] for r in rows}], "doc_id bigint, toxic int")
    lex = toxicity.learn(spark.createDataFrame(rows, "doc_id bigint, text string"), labels)
    assert not [t for t in lex.weights if any(c.isdigit() for c in t)]


def test_clashing_names(spark):
    added = "mix_source mix_rate mix_parts mix_cdf copy n_copies shuffle_key pii_row pii_base pii_terms pii_held pii_all pii_reach pii_c0 term start end".split()
    rows = [(i, f"some words wrote boss{i}@corp.com {i}", "s", *["x"] * len(added)) for i in range(6)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, source string, " + ", ".join(f"{c} string" for c in added))
    mixed = mixing.replicate(frame)
    assert set(frame.columns) == set(mixed.columns) and {r.mix_cdf for r in mixed.collect()} == {"x"}
    clean = pii.sanitise(frame)
    assert clean.columns == frame.columns and {(r.pii_row, r.pii_base, r.term) for r in clean.collect()} == {("x", "x", "x")}
    spans = pii.pii_spans(frame, tuple(frame.columns))
    assert spans.filter("size(pii_base) = 1 AND pii_row = 'x'").count() == 6


def nested(n: int) -> bytes:
    data = b""
    for _ in range(n):
        data = media.box(b"moov", data)
    return data


def test_hostile_containers():
    good = media.mux(media.pad(b"text"))
    at = good.index(b"stsz")
    huge = good[: at + 8] + struct.pack(">II", 1, 0xFFFFFFFF) + good[at + 16 :]
    for bad in (nested(1500), huge, good[:at] + b"stz2" + good[at + 4 :], media.box(b"moov"), media.box(b"moov", media.box(b"trak"))):
        row = media.describe(bad)
        assert row[-1] and row[0] is None


def track(kind: bytes, track_id: int, codec: bytes, sizes: list[int], at: int, stss: list[int] | None = None, compact: bool = False) -> bytes:
    n = len(sizes)
    size = (
        media.full_box(b"stz2", 0, 0, struct.pack(">3xBI", 8, n), bytes(sizes)) if compact
        else media.full_box(b"stsz", 0, 0, struct.pack(">II", 0, n), np.array(sizes, ">u4").tobytes())
    )
    stbl = media.box(
        b"stbl", media.full_box(b"stsd", 0, 0, struct.pack(">I", 1), media.box(codec, bytes(70))), media.full_box(b"stts", 0, 0, struct.pack(">III", 1, n, 2)),
        media.full_box(b"stsc", 0, 0, struct.pack(">IIII", 1, 1, n, 1)), size, media.full_box(b"stco", 0, 0, struct.pack(">II", 1, at)),
        *([media.full_box(b"stss", 0, 0, struct.pack(">I", len(stss)), np.array(stss, ">u4").tobytes())] if stss else []),
    )
    mdhd = media.full_box(b"mdhd", 0, 0, struct.pack(">IIIIHH", 0, 0, 10, 2 * n, 0, 0))
    hdlr = media.full_box(b"hdlr", 0, 0, struct.pack(">I4s12x", 0, kind), b"x\0")
    tkhd = media.full_box(b"tkhd", 0, 3, struct.pack(">III", 0, 0, track_id), bytes(68))
    return media.box(b"trak", tkhd, media.box(b"mdia", mdhd, hdlr, media.box(b"minf", stbl)))


@pytest.mark.parametrize("compact", [False, True])
def test_two_tracks_are_not_mixed(compact):
    payload = bytes(range(200))
    moov = lambda base: media.box(b"moov", track(b"soun", 1, b"mp4a", [5] * 4, base), track(b"vide", 2, b"avc1", [30, 40, 50], base + 20, [1, 3], compact))
    data = moov(len(moov(0)) + 8) + media.box(b"mdat", payload)
    found = media.Track(data)
    assert (found.codec, found.keys.tolist(), found.sizes.tolist()) == ("avc1", [0, 2], [30, 40, 50])
    assert found.payload(data) == payload[20:140]


def test_fragments_are_decoded():
    trex = media.box(b"mvex", media.full_box(b"trex", 0, 0, struct.pack(">IIIII", 1, 1, 3, 10, 0x10000)))
    empty = track(b"vide", 1, b"avc1", [], 0).replace(struct.pack(">IIII", 1, 1, 0, 1), struct.pack(">IIII", 1, 1, 0, 1))
    head = media.box(b"moov", empty, trex)

    def fragment(flags: int, body: bytes, payload: bytes) -> bytes:
        made = lambda offset: media.box(b"moof", media.box(b"traf", media.full_box(b"tfhd", 0, 0x020000, struct.pack(">I", 1)), media.full_box(b"trun", 0, flags | 1, struct.pack(">I", 2), struct.pack(">i", offset), body)))
        return made(len(made(0)) + 8) + media.box(b"mdat", payload)

    data = head + fragment(0x4, struct.pack(">I", 0), b"a" * 10 + b"b" * 10) + fragment(0x200 | 0x400, struct.pack(">IIII", 3, 0, 4, 0x10000), b"ccc" + b"dddd")
    found = media.Track(data)
    assert found.payload(data) == b"a" * 10 + b"b" * 10 + b"ccc" + b"dddd"
    assert (found.keys.tolist(), found.sizes.tolist(), found.media_duration) == ([0, 2], [10, 10, 3, 4], 12)


def test_short_lengths_are_packed_exactly():
    for length, n in ((9, 5000), (1, 3000), (33, 2000)):
        _, sequences = packing.plan({length: n})
        assert sequences == -(-n // (1024 // length))


def test_repeats_spill_and_agree(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = {tuple(r) for r in repeats.remove_repeats(docs).select("doc_id", "n_removed", "kept_sha256").collect()}
    for sizes in ({"memory": 1 << 18}, {"shard_bytes": 100_000, "part_bytes": 50_000}):
        assert {tuple(r) for r in repeats.remove_repeats(docs, **sizes).select("doc_id", "n_removed", "kept_sha256").collect()} == want


def test_a_shard_larger_than_the_memory_recurses_on_disk():
    rng = np.random.default_rng(2)
    words = [rng.integers(2, 30, int(k)).astype(np.int16) for k in rng.integers(3, 9, 300)]
    text = np.concatenate([words[k] for k in rng.integers(0, 300, 40_000)])
    results = []
    for memory in (1 << 26, 1 << 17):
        disk = induced.Disk(memory)
        symbols = np.zeros(len(text) + 51, np.int16)
        symbols[: len(text)] = text
        blocks = [list(b) for b in induced.suffixes(symbols, len(text) + 1, 257, 50, disk)]
        order = np.concatenate([p for b in reversed(blocks) for p, _ in b])
        lcp = np.concatenate([c for b in reversed(blocks) for _, c in b])
        results.append((symbols[order[:, None] + np.arange(50)], lcp))
        assert (disk.spills > 20 and disk.levels > 0) if memory < len(text) else disk.levels == 0
        disk.close()
    assert (results[0][0] == results[1][0]).all() and (results[0][1] == results[1][1]).all()


def test_a_family_larger_than_a_chunk(spark, monkeypatch):
    from test_shingles import kept

    monkeypatch.setattr(shingles, "CHUNK", 16)
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in range(80)]
    rows = []
    for k in range(150):
        text = list(base)
        for at in rng.integers(0, 80, int(rng.integers(0, 5))):
            text[at] = f"x{rng.integers(0, 10**6)}"
        rows.append((k, " ".join(text), "en", "s0", 0))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert {r.doc_id for r in shingles.keep_first(docs).collect()} == kept(rows)


def test_only_windows_that_stand_twice_are_sorted(monkeypatch):
    rng = np.random.default_rng(8)
    raw = [rng.integers(0, 256, int(n), dtype=np.uint8).tobytes() for n in rng.integers(50, 300, 400)]
    raw += [b"a" * 300, b"ab" * 200, b"a" * 90, b"\0" * 77, b"\xff" * 60]
    raw += [raw[k][:30] + raw[k + 1][: 45 + k] + raw[k + 2] for k in range(30)]
    ids = rng.integers(0, 200, len(raw))
    for memory in (1 << 14, 16 << 20):
        monkeypatch.setattr(repeats, "HASHED", 1000)
        disk = induced.Disk(memory)
        own = repeats.Pieces(disk, sum(map(len, raw)), len(raw))
        own.add(raw, ids)
        wanted = np.array(repeats.held_elsewhere(own, disk))
        seen = []
        plain = repeats.held_elsewhere
        monkeypatch.setattr(repeats, "held_elsewhere", lambda p, d: seen.append(p.n) or plain(p, d))  # noqa: B023
        assert (np.array(repeats.flags_of(own, disk)) == wanted).all() and wanted.any()
        monkeypatch.undo()
        # what cannot be told apart within the memory is sorted whole
        assert seen == [own.n] if memory < own.n else seen[0] < own.n // 2
        disk.close()
