from __future__ import annotations

import base64
import random
from collections import Counter

import pytest
import zstandard

from wagerlens.llm import compression_rules as R


def brute(text):
    raw = text or ""
    words = [w for w in "".join(c if c not in " \t\n\x0b\x0c\r" else " " for c in raw).split(" ") if w]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    seen, dup = set(), 0
    for line in raw.split("\n"):
        if line.strip(" \t\n\x0b\x0c\r"):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in raw), dup, len(covered), failed


def test_base_against_brute_force(documents, odd_rows, words):
    draw = random.Random(1)
    texts = [" ".join(draw.choice("abc") for _ in range(n)) for n in (7, 8, 9, 16, 17, 40)] + ["a\x0bb\u00a0c\x1cd # |\r\n$", "\n".join(draw.choice(["x y", "z", "", " "]) for _ in range(40))]
    texts += [" ".join(words(40, 1) + words(12, 2) + words(30, 3) + words(12, 2))]
    rows = odd_rows + [(100 + i, t, "s") for i, t in enumerate(texts)]
    found = R.rules_frame(documents(rows)).collect()
    assert Counter((r.doc_id, *tuple(r)[1:7]) for r in found) == Counter((i, *brute(t)) for i, t, _ in rows)
    assert all(not (r.kept and r.base_failed) for r in found)


def test_compression_bands(spark, documents, words):
    """Prose is kept; prose with a repetitive part, blobs and random words of a-z are not."""
    noise = random.Random(4)
    found = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet").filter("quality = 1"), "doc_id")
    clean = found.filter("length(text) between 12000 and 20000").orderBy("doc_id").first().text
    random_words = " ".join(words(2000, 7, "abcdefghijklmnopqrstuvwxyz"))
    mixed = clean[:6000] + " " + " ".join(f"w{i % 3}" for i in range(900)) + " " + clean[6000:]
    blob = " ".join("".join(chr(noise.randint(0x4E00, 0x9FA0)) for _ in range(9)) for _ in range(300))
    rows = R.rules_frame(documents([(1, clean, "s"), (2, mixed, "s"), (3, blob, "s"), (4, random_words, "s")]), R.Limits(max_repeat_percent=100)).collect()
    kept = {r.doc_id: r.kept for r in rows}
    assert kept == {1: True, 2: False, 3: False, 4: False}
    assert next(r for r in rows if r.doc_id == 2).most_chunk_ratio > 4.2


@pytest.mark.parametrize("size", [70, 100, 130, 200, 300, 450, 600, 800, 900, 1000])
def test_short_noise_and_clean_prose(spark, size):
    """Random base64 words of any short length are rejected; passages of clean documents are not."""
    sf_dir = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1").select("doc_id")
    pack = zstandard.ZstdCompressor(level=R.LEVEL).compress
    draw, noise = random.Random(size), 0
    for _ in range(300):
        raw = b" ".join(base64.b64encode(draw.randbytes(9))[: draw.randint(3, 9)] for _ in range(size))[:size]
        noise += R.judge_text(raw, pack, R.Limits(min_words=5))[6]
    assert noise <= 3
    clean = []
    for row in spark.read.parquet(f"{sf_dir}/documents.parquet").join(labels, "doc_id").select("text").collect():
        raw = row.text.encode()
        clean += [part for k in range(0, min(len(raw), 4000), 500) if len(part := raw[k : k + size]) == size and len(part.split()) >= R.MIN_WORDS]
    verdicts = [R.judge_text(raw, pack, R.Limits(max_repeat_percent=100))[6] for raw in clean]
    assert sum(verdicts) >= 0.995 * len(verdicts) and (size < 128 or len(verdicts) > 200)


NOISE = {
    "base64": lambda draw: base64.b64encode(draw.randbytes(9)),
    "a-z": lambda draw: bytes(draw.choice(b"abcdefghijklmnopqrstuvwxyz") for _ in range(9)),
    "hexadecimal": lambda draw: bytes(draw.choice(b"0123456789abcdef") for _ in range(9)),
}


@pytest.mark.parametrize("kind, least", [("base64", 300), ("a-z", 1024), ("hexadecimal", 4096)])
def test_noise_of_every_length(kind, least):
    """Random words of 3 to 9 letters are rejected wherever a limit can part them from prose."""
    pack, draw = zstandard.ZstdCompressor(level=R.LEVEL).compress, random.Random(kind)
    for size in (300, 512, 700, 900, 1024, 1279, 1500, 2047, 2048, 3000, 4095, 4096, 6000, 8192, 16_384, 32_767, 70_000):
        if size >= least:
            for _ in range(30 if size < 10_000 else 5):
                raw = b" ".join(NOISE[kind](draw)[: draw.randint(3, 9)] for _ in range(size // 3))[:size]
                assert not R.judge_text(raw, pack, R.Limits())[6], size


def test_clean_documents_of_every_length_are_kept(spark):
    """All documents marked as good that the base rules keep, and every one of their beginnings of a length at which a limit changes, but for a few in ten thousand."""
    sf_dir = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1").select("doc_id")
    pack, kept, parts = zstandard.ZstdCompressor(level=R.LEVEL).compress, [], []
    for row in spark.read.parquet(f"{sf_dir}/documents.parquet").join(labels, "doc_id").select("text").collect():
        raw = row.text.encode()
        found = R.judge_text(raw, pack, R.Limits())
        if not found[5]:
            kept.append(found[6])
            parts += [R.in_band(n, n / len(pack(raw[:n])), R.WHOLE_BANDS) for n, _, _ in R.WHOLE_BANDS if 128 <= n <= len(raw) and len(raw[:n].split()) >= R.MIN_WORDS]
    assert all(kept) and len(kept) > 1000
    assert sum(parts) >= 0.999 * len(parts)


@pytest.mark.parametrize("size, ratio, fits", [(10, 99.0, True), (128, 3.0, True), (128, 3.1, False), (600, 1.0, False), (70000, 6.9, True), (70000, 7.1, False)])
def test_in_band(size, ratio, fits):
    assert R.in_band(size, ratio, R.WHOLE_BANDS) is fits


def test_apply_keeps_columns(documents, odd_rows):
    docs = documents(odd_rows)
    kept = R.apply_rules(docs)
    assert kept.columns == docs.columns
    frame = {(r.doc_id, r.kept) for r in R.rules_frame(docs).collect()}
    assert {r.doc_id for r in kept.collect()} == {i for i, k in frame if k}
    assert R.apply_rules(documents([])).count() == R.rules_frame(documents([])).count() == 0


def test_registered_query_keeps_clean_documents(spark):
    sf_dir = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1").select("doc_id")
    good = R.op8_quality_rules(spark, sf_dir).join(labels, "doc_id").filter("not base_failed")
    assert good.filter("not kept").count() == 0 and good.count() > 200
