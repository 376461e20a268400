"""Token ids of whole texts, by a tokenizer file of the tokenizers library.

Texts are cut before every space and line feed, and the pieces told apart, looked up and
put together again as Arrow arrays, so that Python meets only the new ones. A byte-level
vocabulary splits a text before every run of white space that follows
something else, and between a letter and a mark like a full stop, so the parts between
such places can be encoded apart: a new piece is put together from parts, and a text with longer runs of white space is made of parts alone. A new part of letters
alone, with at most a space before, is one piece of the byte-level splitter and goes
straight to the vocabulary's model; the others are encoded in joined runs that are cut again by the byte lengths of the tokens. Texts with
other white space than space and line feed, or with the string of a special token, which
is one id wherever it stands, are encoded whole. The result is the same as encoding
every text whole, with ``add_special_tokens=False``.

An encoder with its table of parts is made once in a Python worker and serves all
tasks that the worker runs. A text of any length is encoded as one; a null is empty.
"""

from __future__ import annotations

import json
import re
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

END = 2
PART = re.compile(r"[ \n]*[^\W\d_]+(?![^ \n.,;:!?|)])|[ \n]*[^ \n]+|[ \n]+")
ODD = re.compile(r"[^\S \n]")
MOST = 600_000  # parts remembered at once; beyond, the half that was met first stays, which has the most frequent ones
CUT = "\0"  # stands before each space and line feed of a text that is cut there
BLANK = [" ", "\n"]
SLICE = 2_000_000  # characters of texts that are encoded at once
RUN = 512  # new parts encoded as one text
LATEST = "\u0530"  # letters before this code point are letters to every version of the character tables
WORKER = "skyledger_worker_tables"  # module of a Python worker that outlives its tasks


def byte_letters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself where it can be printed, else one from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) if b in own else chr(256 + others.index(b)) for b in range(256)}


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids, each with the end id last."""

    def __init__(self, path: str, end: int = END):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or r"(?!)")
        self.parts: dict[str, bytes] = {}
        self.pieces, self.coded = pa.array([], pa.large_string()), pa.array([], pa.large_binary())  # a piece and its ids have the same place
        self.end = np.array([end], "<u4").tobytes()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.code = [i.to_bytes(4, "little") for i in range(max(vocabulary.values()) + 1)]
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.bytes_of[list(vocabulary.values())] = [len(t) for t in vocabulary]  # one character stands for one byte

        split = json.loads(self.tokenizer.to_str())
        self.letters = byte_letters()
        self.model = self.tokenizer.model if split["normalizer"] is None and {**(split["pre_tokenizer"] or {}), "trim_offsets": True} == BYTE_LEVEL else None

    def is_word(self, part: str) -> bool:
        """Whether the byte-level splitter takes the part as one piece."""
        return (part[1:] if part[0] == " " else part).isalpha() and max(part) < LATEST

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, new: list[str]) -> None:
        """Encode new parts; those that start with white space and end without it are joined, as a split stands between them."""
        if self.model is not None:
            rest, tokenize, code, space = [], self.model.tokenize, self.code, self.letters[32]
            for p in new:
                if p.isascii() and (p[1:] if p[0] == " " else p).isalpha():  # the other characters stand for themselves
                    self.parts[p] = b"".join([code[t.id] for t in tokenize(p.replace(" ", space))])
                elif self.is_word(p):
                    self.parts[p] = b"".join([code[t.id] for t in tokenize(p.encode().decode("latin-1").translate(self.letters))])
                else:
                    rest.append(p)
            new = rest
        joined = [p for p in new if p[0] in " \n" and p[-1] not in " \n"]
        alone = [p for p in new if p[0] not in " \n" or p[-1] in " \n"]
        for low in range(0, len(joined), RUN):
            run = joined[low:low + RUN]
            coded = self.whole(["".join(run)])[0]
            ends = np.cumsum(self.bytes_of[np.frombuffer(coded, "<u4")])
            want = np.cumsum([len(p.encode()) for p in run])
            at = np.searchsorted(ends, want)
            if len(ends) and ends[-1] == want[-1] and (ends[at] == want).all():
                cuts = [0, *((at + 1) * 4).tolist()]
                self.parts.update(zip(run, [coded[a:b] for a, b in zip(cuts, cuts[1:])]))
            else:
                alone += run
        for low in range(0, len(alone), 4096):
            self.parts.update(zip(alone[low:low + 4096], self.whole(alone[low:low + 4096])))

    def of_pieces(self, new: list[str]) -> list[bytes]:
        """The ids of pieces that are not in the table of pieces, put together from their parts."""
        if len(self.parts) > MOST:
            self.parts = dict(islice(self.parts.items(), MOST // 2))
        split = [[p] if p[1:].isalpha() and p[0] == " " else PART.findall(p) for p in new]
        self.learn([p for p in {p: 0 for parts in split for p in parts} if p not in self.parts])
        return [b"".join([self.parts[p] for p in parts]) for parts in split]

    def places(self, pieces: pa.Array) -> np.ndarray:
        """The place of each of some distinct pieces in the table of pieces; new ones are added."""
        if len(self.pieces) > MOST:
            self.pieces, self.coded = self.pieces[:MOST // 2], self.coded[:MOST // 2]
        at = pc.index_in(pieces, self.pieces)
        new = pieces.filter(at.is_null())
        at = at.fill_null(-1).to_numpy().copy()
        if len(new):
            at[at < 0] = np.arange(len(self.pieces), len(self.pieces) + len(new))
            coded = pa.array(self.of_pieces(new.to_numpy(zero_copy_only=False).tolist()), pa.large_binary())
            self.pieces, self.coded = pa.concat_arrays([self.pieces, new]), pa.concat_arrays([self.coded, coded])
        return at

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out, low = [], 0
        while low < len(texts):
            high, size = low, 0
            while high < len(texts) and size < SLICE:
                size += len(texts[high] or "")
                high += 1
            out += self.run([t or "" for t in texts[low:high]])
            low = high
        pa.default_memory_pool().release_unused()  # a worker keeps it else while other steps run
        return out

    def run(self, texts: list[str]) -> list[bytes]:
        """Encode some texts at once: their pieces are told apart and looked up by array operations."""
        odd = [CUT in t or ODD.search(t) or self.special.search(t) for t in texts]
        marked = ["" if o else t.replace(" ", CUT + " ").replace("\n", CUT + "\n") for t, o in zip(texts, odd)]
        pieces = pc.split_pattern(pa.array(marked, pa.large_string()), CUT)
        met = pieces.values.dictionary_encode()
        first, index = pieces.offsets.to_numpy(), met.indices.to_numpy()
        blank = pc.is_in(met.dictionary, pa.array(BLANK, pa.large_string())).to_numpy(zero_copy_only=False)[index]
        # white space of three characters or more, or of two at the end, is one piece of the splitter
        spaced = set((np.searchsorted(first, np.flatnonzero(blank[1:] & blank[:-1]), side="right") - 1).tolist())
        at = self.places(met.dictionary)
        ids = self.coded.take(pa.array(at)).take(met.indices)
        _, offsets, data = ids.buffers()
        ends, raw = np.frombuffer(offsets, np.int64)[first].tolist(), memoryview(data or b"")
        out = []
        for k, t in enumerate(texts):
            if odd[k]:
                coded = self.whole([t])[0]
            elif k in spaced:
                parts = PART.findall(t)
                self.learn([p for p in {*parts} if p not in self.parts])
                coded = b"".join([self.parts[p] for p in parts])
            else:
                coded = raw[ends[k]:ends[k + 1]]
            out.append(b"".join([coded, self.end]))
        return out


def encoders(path: str, end: int = END) -> Encoder:
    """One encoder for all tasks of a Python worker; the functions of a task are sent anew with each."""
    import os
    import sys
    import types

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    made = sys.modules.setdefault(WORKER, types.ModuleType(WORKER)).__dict__.setdefault("encoders", {})
    if (path, end) not in made:
        made[path, end] = Encoder(path, end)
    return made[path, end]
