from __future__ import annotations

import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from quillstack.llm.sentencepiece_codec import BPE, UNIGRAM, Codec, encode_documents

from .helpers import awkward, frame

PATH = public_tokenizers.path("piece_bpe_32k.model")
CODEC, LIBRARY = Codec(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aehtno  \n▁é中"), st.characters(exclude_categories=("Cs",))), max_size=50))
def test_ids_are_the_librarys_and_decode_to_the_text(text):
    text = text.replace("\x00", "")
    ids = CODEC.encode(text)
    assert ids == LIBRARY.encode(text)
    assert CODEC.decode(ids) == LIBRARY.decode(ids)


def test_documents(spark):
    rows = awkward()
    got = encode_documents(frame(spark, rows), PATH).collect()
    want = sorted((str(i), LIBRARY.encode(t or "")) for i, t in rows)
    assert sorted((str(r.doc_id), r.ids) for r in got) == want
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in got)
    assert encode_documents(frame(spark, []), PATH).count() == 0


def test_unigram_path_is_the_best_one():
    codec = Codec(PATH)
    codec.model = UNIGRAM
    codec.scores = [-1.0 - 0.37 * (i % 11) for i in range(len(codec.scores))]
    codec.penalty = -40

    def best(text):
        if not text:
            return 0.0
        return max(best(text[: len(text) - n]) + codec.scores[codec.ids[text[-n:]]] for n in range(1, len(text) + 1) if text[-n:] in codec.ids)

    for text in ("▁hello", "▁there", "▁ontion", "▁abc"):
        path = codec._viterbi(text)
        assert "".join(codec.pieces[i] for i in path) == text
        assert abs(sum(codec.scores[i] for i in path) - best(text)) < 1e-9
    assert Codec(PATH).model == BPE
