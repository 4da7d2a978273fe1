import hashlib
import itertools
import os
import random

import pytest

from inkveil.llm import pieces

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, ids string, n_pieces string"
needs_model = pytest.mark.skipif(not os.path.exists(pieces.MODEL), reason="no model file")


def _texts():
    rng = random.Random(1)
    bits = ["the", "thing", "er", " ", " ", "  ", "\n", "é", "ß", "漢", "🙂", ".", "!!!", "\t", "A", "SHOUT", "1234", "<s>", "</s>", "\0", " ", "<0x41>", "aaaa", "tion"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(0, 30))) for _ in range(1500)]
    texts += ["".join(rng.choice("abcdefghinorst ") for _ in range(rng.randrange(0, 80))) for _ in range(1500)]
    return [*texts, "", " ", "   ", "a", " a", "a ", "\n", "x" * 5000, " " * 300 + "b", "word " * 20_000]


@needs_model
def test_same_ids_as_the_library():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    with open(pieces.MODEL, "rb") as f:
        codec = pieces.Codec.load(f.read())
    texts = _texts()
    for t, ids in zip(texts, codec.encode(texts), strict=True):
        assert ids.tolist() == sp.encode(t), t[:100]
        assert codec.decode(ids.tolist()) == t == sp.decode(ids.tolist())


@needs_model
def test_query_round_trips(spark, docs_dir):
    texts = [None, "", "a b", "a▁b", "  x\n\ny ", "a b", "long " * 50_000]
    rows = {r.doc_id: r for r in pieces.op8_sentencepiece_codec(spark, docs_dir([(i, t, "", "", 0, "", "") for i, t in enumerate(texts)], DOCS)).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        assert rows[i].round_trip == (t is None or "▁" not in t)
        assert rows[i].decoded_sha256 == hashlib.sha256((t or "").replace("▁", " ").encode()).hexdigest()
        assert rows[i].n_pieces == len(rows[i].ids)
    assert rows[2].ids == rows[5].ids and rows[0].ids == []
    assert pieces.op8_sentencepiece_codec(spark, docs_dir([], DOCS)).count() == 0


def test_unigram_states_find_the_best_sum():
    names = ["▁", "a", "b", "c", "ab", "bc", "▁a", "abc", "ca", "▁ab"]
    rng = random.Random(4)
    table = {i: (p, -rng.random() * 5) for i, p in enumerate(names)}
    codec = pieces.Codec(table, list(range(100, 356)), unigram=True)
    score = {p: s for p, s in table.values()}

    def best(word):
        out = None
        for cuts in itertools.product((0, 1), repeat=len(word) - 1):
            parts, start = [], 0
            for i, c in enumerate(cuts, 1):
                if c:
                    parts.append(word[start:i])
                    start = i
            parts.append(word[start:])
            if all(p in score for p in parts):
                total = sum(score[p] for p in parts)
                out = max(out or (total, parts), (total, parts))
        return out[1]

    for n in range(1, 7):
        for word in itertools.product("abc", repeat=n):
            text = "".join(word)
            assert [codec.text[i] for i in codec.encode([text])[0].tolist()] == best("▁" + text)


def test_marks_inside_pieces_are_refused():
    with pytest.raises(ValueError):
        pieces.Codec({0: ("a▁b", 0.0)}, [])


def test_model_type_is_read_from_the_model(tmp_path):
    sentencepiece = pytest.importorskip("sentencepiece")
    rng = random.Random(6)
    stems = ["anti", "dis", "establish", "ment", "arian", "ism", "re", "play", "ing", "ed", "er"]
    lines = [" ".join("".join(rng.choices(stems, k=rng.randrange(1, 5))) for _ in range(8)) for _ in range(400)]
    (tmp_path / "lines.txt").write_text("\n".join(lines))
    for kind, unigram in (("unigram", True), ("bpe", False), ("char", None)):
        sentencepiece.SentencePieceTrainer.train(
            input=f"{tmp_path}/lines.txt", model_prefix=f"{tmp_path}/{kind}", model_type=kind, vocab_size=340, hard_vocab_limit=False,
            byte_fallback=True, normalization_rule_name="identity", remove_extra_whitespaces=False, num_threads=1, minloglevel=2,
        )
        model = (tmp_path / f"{kind}.model").read_bytes()
        if unigram is None:
            with pytest.raises(ValueError):
                pieces.Codec.load(model)
            continue
        codec = pieces.Codec.load(model)
        assert codec.unigram == unigram
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        texts = [*lines[:100], "replay é unseen", "xyz antiing", ""]
        assert [x.tolist() for x in codec.encode(texts)] == [sp.encode(t) for t in texts]
