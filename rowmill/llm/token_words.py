"""Encoding by a public tokenizer's library, a chunk of text at a time.

Both tokenizer families below never let a token cross certain places in a text, so a text's tokens are its
chunks' tokens in order, and chunks that repeat (words, mostly) are encoded once. `chunk_rule` reads from the tokenizer's file
whether that holds: `space` for tokenizers that drop white space and encode words, `gap` for byte-level ones whose words
take the space before them. Any other tokenizer gets whole texts.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
from pyspark import TaskContext

from .common import process_store, release

# letters that a mark follows are a chunk: no tokenizer of these families joins the two
_WORD, _MARK = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff", r"!-&(-/:-@\[-`{-~"
# a space or line end that one word follows goes with it; longer white space stays with the text before or after it
_GAP = re.compile(rf"[ \n]?[{_WORD}]++(?=[{_MARK}])|" + r"[ \n]?\S+(?:(?:\s{2,}|[^\S \n])\S*)*|\s+\S*(?:(?:\s{2,}|[^\S \n])\S*)*")
#: A capital before what may be a mark: these begin at U+0300.
_COMPOSED = re.compile(r"[A-Z][^\x00-\u02ff]")
_SPACE = re.compile(rf"[{_WORD}]++(?=[{_MARK}])|[^ \n]+")
#: A mark that letters stand before.
_END = re.compile(rf"[{_MARK}](?<=[{_WORD}][{_MARK}])")
_LETTERS = re.compile(rf"[{_WORD}]+")


def chunk_rule(path: str) -> str | None:
    """`space`, `gap` or None: where a text may be cut without changing its tokens."""
    if not path.endswith(".json"):
        return None
    spec = json.loads(Path(path).read_text())
    if spec.get("truncation") or spec.get("padding") or any(x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] or re.search(r"\s", x["content"]) for x in spec["added_tokens"]):
        return None
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer") or {}
    if not norm and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
        return "gap"
    kinds = [x["type"] for x in norm.get("normalizers", [])]
    parts = pre.get("pretokenizers", [])
    if kinds == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in parts] == ["Split", "ByteLevel"] and parts[0]["behavior"] == "Removed" and parts[0]["invert"] and r"[^\s\p{L}\p{N}]+" in parts[0]["pattern"].get("Regex", ""):
        return "space"
    return None


def tokenizer_version(path: str) -> str:
    """A digest of the tokenizer's file and the library that reads it."""
    if path.endswith(".json"):
        import tokenizers as library
    else:
        import sentencepiece as library
    return hashlib.sha256(Path(path).read_bytes() + f"|{library.__name__} {library.__version__}".encode()).hexdigest()


def library_encoder(path: str) -> Callable[[list[str]], list[list[int]]]:
    """The library's own batch encoding, without special tokens added."""
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return lambda texts: [x.ids for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda texts: pieces.encode(texts, num_threads=1)


def separator(path: str) -> tuple[str, int] | None:
    """A special token and its id, by which a tokenizer of the `space` rule parts texts before it does anything else; None if it has none."""
    if chunk_rule(path) != "space":
        return None
    return next(((x["content"], x["id"]) for x in json.loads(Path(path).read_text())["added_tokens"] if x["special"]), None)


def word_encoder(path: str) -> Callable[[list[str]], list[bytes] | None] | None:
    """For a tokenizer of the `space` rule whose words' last tokens are marked: the ids, four bytes each, of chunks of nothing but letters; None where the marks do not part them.

    Of the rule's steps such chunks need only lower case and their bytes' letters, as they are composed and match the rule's pattern whole. So the library runs
    its model without the search for composed letters, white space and the pattern, which take half of its time."""
    from tokenizers import Tokenizer, pre_tokenizers

    spec = json.loads(Path(path).read_text()) if chunk_rule(path) == "space" else {}
    model = spec.get("model", {})
    mark = model.get("end_of_word_suffix")
    if model.get("type") != "BPE" or not mark or model.get("dropout") or model.get("continuing_subword_prefix"):
        return None
    last = np.zeros(1 + max([*model["vocab"].values(), *(x["id"] for x in spec["added_tokens"])]), bool)
    last[[i for token, i in model["vocab"].items() if token.endswith(mark)]] = True
    tokenizer = Tokenizer.from_file(path)
    tokenizer.normalizer = None
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])

    def run(chunks: list[str]) -> list[bytes] | None:
        ids = np.array(tokenizer.encode_batch_fast([" ".join(chunks).lower()], add_special_tokens=False)[0].ids, np.uint32)
        ends = (4 * np.flatnonzero(last[ids]) + 4).tolist()
        raw = ids.tobytes()
        return [raw[a:z] for a, z in zip([0, *ends], ends, strict=False)] if len(ends) == len(chunks) else None

    return run


def shared_encoder(path: str) -> ChunkEncoder:
    """This worker's encoder for a tokenizer, kept from task to task of a stage."""
    release()
    store, context = process_store(), TaskContext.get()
    if store.get("kept", (None,))[0] != path:
        store["kept"] = (path, ChunkEncoder(path))
    store["stage"] = context.stageId() if context is not None else None
    return store["kept"][1]


class Cache(dict):
    """Ids of chunks. Asked for others, it gives an empty bytearray for each, in `unseen`, which is to be filled."""

    def __init__(self):
        self.unseen: dict[str, bytearray] = {}

    def __missing__(self, chunk: str) -> bytearray:
        return self.unseen.setdefault(chunk, bytearray())


class ChunkEncoder:
    """Ids of texts. Up to `capacity` chunks of at most `longest` characters stay in memory; once half of that is full, only chunks that are met a second time."""

    def __init__(self, path: str, capacity: int = 500_000, longest: int = 48):
        self.rule, self.encode, self.separator, self.letters = chunk_rule(path), library_encoder(path), separator(path), word_encoder(path)
        self.capacity, self.longest = capacity, longest
        self.cache = Cache()
        self.met = bytearray(1 << 22)

    def chunks(self, text: str) -> list[str]:
        if self.rule == "space":
            # such a tokenizer drops case after composing letters with the marks that follow them, so letters before marks
            # keep theirs; so do special tokens, which it looks for first
            if "<|" in text or not text.isascii() and _COMPOSED.search(text):
                return _SPACE.findall(text)
            # twice as fast as finding words; there are empty chunks between spaces
            return _END.sub(r" \g<0>", text.encode().lower().decode()).replace("\n", " ").split(" ")
        return _GAP.findall(text) if self.rule == "gap" else [text]

    def encode_unseen(self, chunks: list[str]) -> dict[str, bytes]:
        """Each chunk's ids, four bytes each, those of nothing but letters by the shorter way."""
        out: dict[str, bytes] = {}
        if self.letters:
            plain = list(filter(_LETTERS.fullmatch, chunks))
            if plain and (ids := self.letters(plain)):
                out = dict(zip(plain, ids, strict=True))
                chunks = [c for c in chunks if c not in out]
        return out | dict(zip(chunks, self.encoded(chunks), strict=True)) if chunks else out

    def encoded(self, chunks: list[str]) -> list[bytes]:
        """Each chunk's ids, four bytes each. The library takes one long text faster than many short ones, so chunks are joined by a separator."""
        if self.separator and len(chunks) > 1:
            text, number = self.separator
            ids = np.array(self.encode([text.join(chunks)])[0], np.uint32)
            cuts = np.flatnonzero(ids == number)
            if len(cuts) == len(chunks) - 1:  # else a chunk holds the separator
                raw, ends = ids.tobytes(), [*(4 * cuts).tolist(), 4 * len(ids)]
                return [raw[a:z] for a, z in zip([0, *(z + 4 for z in ends[:-1])], ends, strict=True)]
        return [array("I", x).tobytes() for x in self.encode(chunks)]

    def raw(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Each text's ids, four bytes each."""
        self.cache.unseen = unseen = {}
        parts = [list(map(self.cache.__getitem__, self.chunks(t))) for t in texts]
        asked = list(unseen)
        for at in range(0, len(asked), 1 << 11):
            for c, ids in self.encode_unseen(asked[at : at + (1 << 11)]).items():
                unseen[c] += ids
                if len(self.cache) < self.capacity:
                    if (self.met[h := hash(c) & 0x3FFFFF] or len(self.cache) < self.capacity // 2) and len(c) <= self.longest:
                        self.cache[c] = ids
                    self.met[h] = 1
        for have in parts:
            yield b"".join(have)

    def ids(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """An array of uint32 ids for each text."""
        return (np.frombuffer(x, np.uint32) for x in self.raw(texts))

    def counts(self, texts: Iterable[str]) -> list[int]:
        return [len(x) // 4 for x in self.raw(texts)]
