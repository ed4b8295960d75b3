"""Token ids of whole texts by a public tokenizer, remembered per word.

Both vocabularies cut a text before byte-pair merging, and never inside a run
of white space and the word behind it. So the ids of a text are those of its
pieces in a row, and a piece seen before need not be encoded again. Texts with
white space beyond the six ASCII characters, or with a special token's string,
go to the tokenizer whole: there the pieces could hang together.

Many texts are cut at once by Arrow, and each distinct piece of theirs is looked
up once. New words of ASCII and Latin-1 letters, which are one unit to the
tokenizer, go to its byte-pair model alone; other pieces go through all of it.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# White space the tokenizers know beyond bytes.split().
ODD = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")
PIECE = re.compile(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")
# White space other than single blanks and line ends; there a run must stay with the word behind it.
UNEVEN = ("  ", " \n", "\n ", "\n\n", "\t", "\x0b", "\x0c", "\r", "\0")
REMEMBERED = 1_000_000
# Marks that the tokenizers always cut from the letters before them, and never join with what comes before that.
MARKS = ".,!?;:#$%&*|<>()[]{}+=~^\"-/\\"
# Letters that no normalization changes but lower-casing, one by one.
LETTERS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"
# Behind these, marks are always cut off.
ENDS = {c for c in map(chr, range(256)) if re.match(f"[0-9{LETTERS}]", c)}


def byte_letters() -> dict[int, int]:
    """The letter by which byte-level vocabularies write each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(rest)}


class Encoder:
    """ids(texts): little-endian unsigned 32-bit ids. `spaces`: pieces keep the white space before them.

    Pieces are remembered up to a bound; marks behind a letter or digit are a
    piece of their own. What finds no room any more is encoded whenever it comes.
    """

    def __init__(self, path: str, spaces: bool, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer, self.spaces, self.remembered, self.seen = Tokenizer.from_file(path), spaces, remembered, {"": b""}
        self.model, self.spelling = self.tokenizer.model, byte_letters()
        self.plain = re.compile(f" ?[{LETTERS}]+" if spaces else f"[{LETTERS}]+").fullmatch

    def encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def learn(self, new: set[str]) -> dict[str, bytes]:
        """Ids of distinct new pieces."""
        plain, spaces, spelling, tokenize = self.plain, self.spaces, self.spelling, self.model.tokenize
        found, whole = {}, []
        for p in new:
            if plain(p):
                word = p if spaces else p.lower()
                spelt = word.translate(spelling) if word.isascii() else word.encode().decode("latin-1").translate(spelling)
                found[p] = array("I", [t.id for t in tokenize(spelt)]).tobytes()
            else:
                whole.append(p)
        if whole:
            found.update(zip(whole, self.encode(whole)))
        return found

    def of_pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces."""
        get = self.seen.get
        out = list(map(get, pieces))
        late, heads, tails, new = [], [], [], set()
        for i, ids in enumerate(out):
            if ids is None:
                p = pieces[i]
                head = p.rstrip(MARKS)
                if head == p or head[-1:] not in ENDS:
                    late.append(i), heads.append(p), tails.append("")
                    new.add(p)
                    continue
                tail = p[len(head):]
                first, rest = get(head), get(tail)
                if first is None or rest is None:
                    late.append(i), heads.append(head), tails.append(tail)
                    new.update(x for x, known in ((head, first), (tail, rest)) if known is None)
                else:
                    out[i] = first + rest
        if late:
            found = self.learn(new)
            for i, head, tail in zip(late, heads, tails):
                first, rest = found.get(head), found.get(tail)
                out[i] = (get(head) if first is None else first) + (get(tail) if rest is None else rest)
            if len(self.seen) + len(found) <= self.remembered:
                self.seen.update(found)
        return out

    def cut(self, texts: list[str], even: bool) -> tuple[np.ndarray, pa.Array]:
        """The bounds of every text among all pieces, and the pieces."""
        if not even:
            lists = [PIECE.findall(t) for t in texts]
            return np.cumsum([0, *map(len, lists)]), pa.array([p for x in lists for p in x], pa.large_string())
        table = pa.array(texts, pa.large_string())
        if self.spaces:
            marked = pc.replace_substring(pc.replace_substring(table, "\n", "\0\n\0"), " ", "\0 ")
            lists = pc.split_pattern(marked, "\0")
        else:
            lists = pc.ascii_split_whitespace(table)
        return lists.offsets.to_numpy(), lists.values

    def of_texts(self, texts: list[str], even: bool = True) -> list[bytes]:
        """Ids of texts without odd white space and special tokens."""
        bounds, pieces = self.cut(texts, even)
        coded = pieces.dictionary_encode()
        which = coded.indices.to_numpy()
        found = self.of_pieces(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        size = np.fromiter(map(len, found), np.int32, len(found)) // 4
        ids = np.frombuffer(b"".join(found), "<u4")
        length = size[which]
        end = np.cumsum(length, dtype=np.int64)
        shift = (np.cumsum(size, dtype=np.int64) - size)[which] - end + length
        flat = np.repeat(shift, length)
        flat += np.arange(len(flat))
        raw = ids[flat].tobytes()
        at = (np.concatenate([[0], end])[bounds] * 4).tolist()
        return [raw[i:j] for i, j in zip(at, at[1:])]

    def ids(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        odd, uneven, even = [], [], []
        for i, t in enumerate(texts):
            if t:
                if "<|" in t or ODD.search(t):
                    odd.append(i)
                elif self.spaces and any([mark in t for mark in UNEVEN]):
                    uneven.append(i)
                else:
                    even.append(i)
        for rows, how in ((odd, self.encode), (uneven, lambda some: self.of_texts(some, False)), (even, self.of_texts)):
            if rows:
                for i, ids in zip(rows, how([texts[i] for i in rows])):
                    out[i] = ids
        return out


def encoded(enc: Encoder, batches: Iterable[pa.RecordBatch], characters: int = 3_000_000):
    """(doc_id, ids) of the rows of Arrow batches (doc_id, text), texts of about so many characters at a time."""
    doc_ids, texts, held = [], [], 0
    for b in batches:
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            doc_ids.append(doc_id), texts.append(text)
            held += len(text or "")
            if held >= characters:
                yield from zip(doc_ids, enc.ids(texts))
                doc_ids, texts, held = [], [], 0
    yield from zip(doc_ids, enc.ids(texts))


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, spaces: bool, remembered: int = REMEMBERED) -> Encoder:
    """One encoder per Python worker, so that its memory serves all its tasks."""
    if (path, spaces) not in _ENCODERS:
        _ENCODERS[path, spaces] = Encoder(path, spaces, remembered)
    return _ENCODERS[path, spaces]
