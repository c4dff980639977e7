"""Token ids, frames and packing: exact round trips."""

import collections
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusmill.llm import packing, token_frames
from corpusmill.llm.tokens import Encoder, default_tokenizer_path, encode_documents
from tests.llm.conftest import prose


@pytest.fixture(scope="module")
def whole():
    tokenizer = Tokenizer.from_file(default_tokenizer_path())
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids + [2]


def test_cut_texts_encode_as_whole(whole):
    rng = random.Random(3)
    parts = ["a", "b", " ", " ", " ", "\n", "\t", "\r", "\x0b", "\xa0", "　", "\x85", "\x1c", "'s", "'", "1", "é", "½", "Ω", "á", "!", "<|endoftext|>", "x'll", "日", "ß"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(4000)] + [None, "", " ", "  ", prose(1, 5000)]
    ids, bounds = encode_documents(Encoder(default_tokenizer_path()), pa.array(texts), 2)
    for text, a, b in zip(texts, bounds, bounds[1:]):
        assert ids[a:b].tolist() == whole(text), repr(text)


def check_packing(pieces, texts, whole, length):
    by_sequence, by_text = collections.defaultdict(list), collections.defaultdict(list)
    for r in pieces:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        by_text[r["id"]].append(r)
    for places in by_sequence.values():
        at = 0
        for offset, size in sorted(places):
            assert offset == at
            at += size
        assert at <= length
    for doc_id, text in texts.items():
        ids, at = np.array(whole(text), "<u4"), 0
        for k, r in enumerate(sorted(by_text[doc_id], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (k, at) and (k == 0 or r["length"] == length)
            assert zlib.crc32(ids[at : at + r["length"]].tobytes()) == r["crc32"]
            at += r["length"]
        assert at == len(ids) and (len(ids) > length or len(by_text[doc_id]) == 1)
    return len(by_sequence)


@pytest.mark.parametrize("length", [1024, 16])
def test_packing_is_exact_and_tight(sample, whole, length):
    pieces = packing.packed(sample, length=length).collect()
    used = check_packing(pieces, {r["doc_id"]: r["text"] for r in sample.collect()}, whole, length)
    assert used <= 1.02 * -(-sum(r["length"] for r in pieces) // length) + 2


def test_plan_fills_like_best_fit():
    rng = random.Random(1)
    for _ in range(200):
        length = rng.choice([8, 30, 100])
        sizes = [rng.randint(1, length - 1) for _ in range(rng.randint(0, 60))] + [rng.randint(1, 3)] * rng.randint(0, 200)
        rows, sequences = packing.plan_slots(collections.Counter(sizes), length)
        space = []
        for size in sorted(sizes, reverse=True):  # best-fit decreasing, one item after the other
            fits = [k for k, s in enumerate(space) if s >= size]
            if fits:
                space[min(fits, key=lambda k: space[k])] -= size
            else:
                space.append(length - size)
        assert sequences == len(space)
        assert sum(b - a for _, a, b, *_ in rows) == len(sizes)


def test_sequences_hold_the_ids(sample, whole):
    pieces = packing.packed(sample.where("doc_id < 40"), length=64, with_ids=True)
    found = {r["sequence_id"]: r for r in packing.sequences(pieces).collect()}
    total = sum(len(whole(r["text"])) for r in sample.where("doc_id < 40").collect())
    assert sum(r["n_tokens"] for r in found.values()) == total
    assert all(len(r["ids"]) == 4 * r["n_tokens"] and r["n_tokens"] <= 64 for r in found.values())


def test_packing_of_awkward_rows(awkward, nothing):
    pieces = packing.packed(awkward).collect()
    assert len({(r["id"], r["sequence_id"], r["offset"]) for r in pieces}) == len(pieces)
    assert sum(r["piece"] == 0 for r in pieces) == awkward.count()
    assert [r["length"] for r in pieces if r["id"] == 3] == [1]
    assert packing.packed(nothing).count() == 0


def test_frames_round_trip(sample, whole, folder):
    manifest = token_frames.write_frames(sample.repartition(4), folder("frames"), files=3)
    start = 0
    found = {r["doc_id"]: r for r in token_frames.read_frames(manifest, payloads=True).collect()}
    for r in sample.orderBy("doc_id").collect():
        ids = np.array(whole(r["text"]), "<u4")
        got = found[r["doc_id"]]
        assert (got["start"], got["n_tokens"], got["ids_crc32"], got["ids"]) == (start, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes())
        start += len(ids)
    some = token_frames.read_frames(manifest, [3, 150, 99_999]).collect()
    assert {(r["doc_id"], r["start"]) for r in some} == {(i, found[i]["start"]) for i in (3, 150)}


def test_any_zstandard_reader_reads_the_stream(sample, whole, folder):
    import zstandard

    row = token_frames.write_frames(sample.where("doc_id < 20"), folder("one"), files=1).first()
    path = row["file"].removeprefix("file://")
    with open(path, "rb") as source:
        data = zstandard.ZstdDecompressor().stream_reader(source, read_across_frames=True).read()
    ids = [i for r in sample.where("doc_id < 20").orderBy("doc_id").collect() for i in whole(r["text"])]
    assert data == np.array(ids, "<u4").tobytes()


def test_damage_is_found(sample, folder):
    row = token_frames.write_frames(sample.where("doc_id < 5"), folder("bad"), files=1).first()
    path = row["file"].removeprefix("file://")
    data = bytearray(open(path, "rb").read())
    with open(path, "rb") as source:
        reader = token_frames.FrameReader(source, len(data))
        data[int(reader.starts[1]) - 3] ^= 0xFF
    open(path, "wb").write(data)
    with open(path, "rb") as source, pytest.raises(Exception):
        reader = token_frames.FrameReader(source, len(data))
        reader.payload(0)


def test_frames_of_awkward_rows(awkward, nothing, folder):
    manifest = token_frames.write_frames(awkward, folder("awkward"))
    found = token_frames.read_frames(manifest).collect()
    assert len(found) == awkward.count()
    assert sorted(r["start"] for r in found)[0] == 0 and len({r["start"] for r in found}) == len(found)
    assert sum(r["doc_id"] is None for r in found) == 2 and all(r["start"] < 200 for r in found if r["doc_id"] is None)
    assert token_frames.read_frames(token_frames.write_frames(nothing, folder("nothing"))).count() == 0
    assert F is not None
