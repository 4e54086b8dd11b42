import random

from tokenizers import Tokenizer

from relgraph.llm import tokens

STRANGE = ["<|endoftext|>", "'s", "'LL", "n't", "’", "\xa0", "​", "　", "\x1c", "\x85", "\x0b", "א", "中", "🙂", "́", "½", "²", "_", "\r\n"]


def test_pieces_give_the_ids_of_whole_texts(monkeypatch):
    monkeypatch.setattr(tokens, "_loaded", {})
    monkeypatch.setattr(tokens, "_CACHED", 500)
    rng = random.Random(3)
    parts = [*"aébzA09.,!<|> \n\t", " ", "  ", " the", " Übung,", *STRANGE]
    texts = ["".join(rng.choices(parts, k=rng.randrange(30))) for _ in range(3000)] + [None, ""]
    whole = Tokenizer.from_file(tokens.DEFAULT)
    for text, ids in zip(texts, tokens.encode(texts)):
        assert ids.tolist() == whole.encode(text or "", add_special_tokens=False).ids, repr(text)


def test_each_piece_is_encoded_once_whatever_stands_beside_it(monkeypatch):
    monkeypatch.setattr(tokens, "_loaded", {})
    tokens.encode([""])
    encoder, asked = tokens._loaded[tokens.DEFAULT], []
    encoder.pieces.make = lambda piece: asked.append(piece) or encoder.piece(piece)
    tokens.encode(["Oh wordless wordless! wordless;\nwordless (wordless) wordless?", "Oh wordless"])
    assert sorted(asked) == sorted(["Oh", " wordless", "!", ";", "\n", "wordless", " (", ")", "?"]) and not encoder.words
