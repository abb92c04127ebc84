"""Token ids of whole texts by a public tokenizer file, fast enough for a corpus: a word is encoded once and remembered."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Chunks of these letters alone are cut into words here, as the word tokenizer's own pattern cuts them; all others go to the tokenizer whole.
PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^0-9a-zß-öø-ÿ]+")
#: The same with the space that stands after a chunk.
WORD_OR_END = re.compile(WORD.pattern.replace("[^0-9a", "[^ 0-9a") + "| ")
#: Texts of such chunks alone, and the words of these texts.
PLAIN_TEXT = re.compile(r"[ \n\t\r!-~À-ÖØ-öø-ÿ]*")
TEXT_WORD = re.compile(WORD.pattern.replace("[^0-9a", r"[^ \n\t\r0-9a"))
NO_ID, STEP = 0xFFFFFFFF, 512
MOST = 500_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Ids of a word-end BPE file whose words never cross white space: a text's ids are its chunks' ids in a row."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        self.words: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}  # the words of the last generation, looked up before the tokenizer is asked
        self.chunks: dict[str, bytes] = {"": b""}

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn_words(self, words: list[str]) -> None:
        if self.before:
            self.words.update((w, self.before[w]) for w in words if w in self.before)
            words = [w for w in words if w not in self.words]
        for at in range(0, len(words), 20_000):
            part = words[at : at + 20_000]
            ids = self._ids([" ".join(part)])[0]
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(part):
                data, cuts = ids.tobytes(), [0, *(stops * 4).tolist()]
                self.words.update((w, data[a:b]) for w, a, b in zip(part, cuts, cuts[1:]))
            else:  # a word of which the tokenizer makes several: each by itself
                self.words.update(zip(part, (x.tobytes() for x in self._ids(part))))

    def _learn(self, chunks: list[str]) -> None:
        if len(self.words) > MOST:
            self.before, self.words = self.words, {}
        plain, odd = [], []
        for c in chunks:
            (plain if PLAIN.fullmatch(c) and "<|" not in c else odd).append(c)
        # All plain chunks are cut in one pass, with a space, which no word holds, after each.
        words = WORD_OR_END.findall(" ".join(plain).lower())
        self._learn_words(list(set(words) - self.words.keys() - {" "}))
        self.words[" "] = b"\xff\xff\xff\xff"  # no id
        ids = np.frombuffer(b"".join(map(self.words.__getitem__, words)), "<u4")
        ends = np.flatnonzero(ids == NO_ID)
        data, cuts = ids.tobytes(), [-4, *(ends * 4).tolist(), len(ids) * 4]
        if plain:
            self.chunks.update((c, data[a + 4 : b]) for c, a, b in zip(plain, cuts, cuts[1:], strict=False))
        if odd:
            self.chunks.update(zip(odd, (x.tobytes() for x in self._ids(odd))))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text (null: none), a bounded number of texts at a time."""
        out: list[bytes] = []
        for at in range(0, len(texts), STEP):
            part = [t or "" for t in texts[at : at + STEP]]
            odd = [k for k, t in enumerate(part) if not PLAIN_TEXT.fullmatch(t) or "<|" in t]
            for k in odd:
                part[k] = self._chunked(part[k])
            cut = [TEXT_WORD.findall(t.lower()) if isinstance(t, str) else () for t in part]
            new = set().union(*cut) - self.words.keys()
            if new:
                if len(self.words) > MOST:
                    self.before, self.words = self.words, {}
                    new = set().union(*cut)
                self._learn_words(list(new))
            ids = self.words
            out += [b"".join(map(ids.__getitem__, x)) if isinstance(t, str) else t for t, x in zip(part, cut)]
        return out

    def _chunked(self, text: str) -> bytes:
        """A text with other letters or signs: its plain chunks by words, the others by the tokenizer itself."""
        chunks = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        if len(self.chunks) > MOST:
            self.chunks = {"": b""}
        if new := set(chunks) - self.chunks.keys():
            self._learn(list(new))
        return b"".join(map(self.chunks.__getitem__, chunks))


def slices(batches: Iterator[pa.RecordBatch], rows: int = STEP) -> Iterator[pa.RecordBatch]:
    """The batches in smaller ones, so that what is made of one stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    """One encoder for a worker process, kept over its tasks."""
    return WordEncoder(path)
