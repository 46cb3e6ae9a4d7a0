import random

import pytest
import tiktoken
from pyspark.sql import functions as F

from preflens.llm import bpe

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding(
        "test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={}
    )


def test_random_texts_encode_as_the_library_does(library):
    rng, encoder = random.Random(3), bpe.encoder(PATH, public_tokenizers.PATTERN)
    tokens = list(encoder.transducer.ranks)
    for _ in range(3000):
        kind = rng.random()
        if kind < 0.3:
            text = "".join(rng.choice("abcde ") for _ in range(rng.randint(0, 60)))
        elif kind < 0.6:
            text = "".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(128, 0x3000), 0x85, 0x1F600])) for _ in range(30))
        elif kind < 0.8:
            text = b"".join(rng.choice(tokens) for _ in range(8)).decode("utf-8", "ignore")
        else:
            text = rng.choice(["a", "ab", " ", "\n", "é", "==", "字"]) * rng.randint(1, 2000)
        ids = encoder.encode(text).tolist()
        assert ids == library.encode_ordinary(text)
        assert "".join(bpe.decode_stream(ids, encoder.transducer.bytes_of, step=3)) == text


def test_few_states_and_pieces_give_the_same_ids(library, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_STATES", 20)
    monkeypatch.setattr(bpe, "MAX_PIECES", 5)
    small = bpe.Encoder(bpe.read_ranks(PATH), public_tokenizers.PATTERN)
    text = " ".join(f"word{i % 40}ing unforeseeable" for i in range(300))
    assert small.encode(text).tolist() == library.encode_ordinary(text)
    assert len(small.transducer.states) <= 20 and len(small) <= 5


def test_long_pieces_are_emitted_before_their_end(library):
    run = bpe.encoder(PATH, public_tokenizers.PATTERN).transducer.run(("abcdefgh" * 4000).encode())
    parts = [p for p in run if p]
    assert len(parts) > 10 and sum(parts, []) == library.encode_ordinary("abcdefgh" * 4000)


def test_stream_holds_back_unfinished_characters():
    stream, data = bpe.Utf8Stream(), "aé字\U0001f600b".encode()
    assert "".join(stream.feed(data[i : i + 1]) for i in range(len(data))) + stream.close() == "aé字\U0001f600b"
    assert stream.feed(b"\xe5\xad") == "" and stream.close() == "\ufffd"


def test_ranks_that_do_not_merge_to_themselves_are_refused():
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 256}
    with pytest.raises(ValueError):
        bpe.Transducer(ranks).encode(b"abcabc")


def test_documents_round_trip(documents, no_documents, texts, library):
    coded = documents.select("doc_id", "text", bpe.encode(F.col("text"), PATH, public_tokenizers.PATTERN).alias("ids"))
    read = coded.select("doc_id", "ids", bpe.decode(F.col("ids"), PATH, public_tokenizers.PATTERN).alias("again")).collect()
    for r in read:
        want = library.encode_ordinary(texts[r.doc_id] or "")
        assert bytes(r.ids) == b"".join(i.to_bytes(4, "little") for i in want) and r.again == (texts[r.doc_id] or "")
    assert no_documents.select(bpe.encode(F.col("text"), PATH, public_tokenizers.PATTERN)).count() == 0
