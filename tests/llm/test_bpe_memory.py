"""What a worker of the encoder remembers is bounded."""

import public_tokenizers

from pagewatch.llm import bpe


def test_encoder_remembers_few_pieces_and_encodes_the_others_all_the_same(monkeypatch):
    codec = bpe.BpeCodec.from_file(public_tokenizers.path("word_bpe_49k.json"))
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    text = " ".join(f"word{n}x{n % 7}" for n in range(400))
    memory: dict = {}
    few = codec.encode_all([text, text], memory)
    assert max(map(len, memory.values())) <= 50
    monkeypatch.setattr(bpe, "REMEMBERED", 10_000)
    assert [a.tolist() for a in few] == [a.tolist() for a in codec.encode_all([text, text], {})]


def test_what_an_encoder_may_remember_stays_below_fifty_megabytes():
    assert 2 * bpe.REMEMBERED * 250 <= 50e6
