"""Token ids of whole texts by the ``tokenizers`` library, memoised by word.

The vocabulary's pre-tokeniser never joins characters across white space and its normaliser
turns every run of white space into one dropped space, so the ids of a text are the ids of
its space-separated chunks in order. Chunks repeat, texts do not: each distinct chunk goes
through the library once per worker and generation of the memo.

Two more rules make chunks repeat sooner. The normaliser lower-cases, so A-Z are lower-cased
before chunks are looked up; a text with combining marks (U+0300 to U+037F) is left as it
is, since composition comes before lower-casing and not every pair composes in both cases.
The pre-tokeniser parts a letter from a full stop or comma, so such an ending is looked up
for itself. The library takes added tokens (``<|endoftext|>``) out of the text as it stands,
before it is lower-cased: a text that has one in any case is left as it is, too.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tallow.llm.words import slices

VOCABULARY = "word_bpe_49k.json"

#: Chunks kept per generation of the memo; two generations are alive at most.
MEMO_WORDS = 600_000
#: Unseen words that are encoded as one text.
JOINED = 128
#: Bytes of text whose chunks are held as Python objects at once.
SLICE_BYTES = 2 << 20


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


LOWER = bytes(b + 32 if 65 <= b <= 90 else 32 if b == 10 else b for b in range(256))
BREAKS = bytes(32 if b == 10 else b for b in range(256))


def chunked(text: str, added: tuple[bytes, ...] = ()) -> bytes:
    """UTF-8 of a text whose chunks are parted by spaces; ``added``: added tokens in lower case."""
    data = text.encode("utf-8", "replace")
    lowered = data.translate(LOWER)
    return data.translate(BREAKS) if b"\xcc" in data or b"\xcd" in data or any(x in lowered for x in added) else lowered


class Encoder:
    """``encode_all(texts)`` gives the ids of each text as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, memo_words: int = MEMO_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = tuple(x.content.encode().translate(LOWER) for x in self.tokenizer.get_added_tokens_decoder().values())
        self.mark = next(((x.content, i) for i, x in sorted(self.tokenizer.get_added_tokens_decoder().items()) if not (x.lstrip or x.rstrip or x.normalized or x.single_word) and self.tokenizer.encode(x.content, add_special_tokens=False).ids == [i]), None)
        self.memo_words = memo_words
        self.young: dict[bytes, bytes] = {b"": b""}
        self.old: dict[bytes, bytes] = {}
        self.endings = {end: self._encode([end])[0] for end in (".", ",")}

    def _encode(self, words: list[str]) -> list[bytes]:
        """Ids of each word. Words go through the library joined by an added token, which parts
        texts before anything else is done to them; words that hold one go by themselves."""
        mark = self.mark
        if not mark or any(mark[0] in w for w in words):
            return [array("I", x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        texts = [mark[0].join(words[at : at + JOINED]) for at in range(0, len(words), JOINED)]
        out: list[bytes] = []
        for found in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
            data = array("I", found.ids).tobytes()
            cuts = 4 * np.flatnonzero(np.frombuffer(data, np.uint32) == mark[1])
            out += [data[a:b] for a, b in zip([0, *(cuts + 4).tolist()], [*cuts.tolist(), len(data)])]
        return out

    def _known(self, words: set[bytes]) -> set[bytes]:
        """Moves what the old generation knows to the young one; the words that neither knows."""
        young, old = self.young, self.old
        missing = words.difference(young)
        if old and missing:
            known = missing.intersection(old)
            young.update((w, old[w]) for w in known)
            missing -= known
        return missing

    def _learn(self, words: set[bytes]) -> None:
        ended: list[tuple[bytes, bytes, bytes]] = []
        whole: set[bytes] = set()
        for word in self._known(words):
            text = word.decode()
            if text[-1] in self.endings and text[-2:-1].isalpha():
                ended.append((word, word[:-1], self.endings[text[-1]]))
                whole.add(word[:-1])
            else:
                whole.add(word)
        todo = list(self._known(whole))
        for at in range(0, len(todo), 4096):
            part = todo[at : at + 4096]
            self.young.update(zip(part, self._encode([w.decode() for w in part])))
        young = self.young
        young.update((word, young[stem] + end) for word, stem, end in ended)

    def _turn(self) -> None:
        if len(self.young) > self.memo_words:
            self.old, self.young = self.young, {b"": b""}

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        group: list[bytes] = []
        held = 0
        for text in texts:
            data = chunked(text or "", self.added)
            if len(data) > SLICE_BYTES:
                yield from self._flush(group)
                group, held = [], 0
                yield b"".join(next(self._flush([s])) for s in slices(data))
                continue
            group.append(data)
            held += len(data)
            if held > SLICE_BYTES:
                yield from self._flush(group)
                group, held = [], 0
        yield from self._flush(group)

    def _flush(self, group: list[bytes]) -> Iterator[bytes]:
        """Ids of each text. Arrow splits the texts and numbers their distinct words; ids are gathered by number."""
        if not group:
            return
        self._turn()
        lists = pc.split_pattern(pa.array(group, pa.binary()), " ")
        numbered = lists.flatten().dictionary_encode()
        words, at = numbered.dictionary.to_pylist(), numbered.indices.to_numpy()
        self._learn(set(words))
        found = list(map(self.young.__getitem__, words))
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        blob = np.frombuffer(b"".join(found), np.uint32)
        starts = np.cumsum(sizes) - sizes
        ends = np.cumsum(sizes[at])
        begins = ends - sizes[at]
        ids = blob[np.repeat(starts[at] - begins, sizes[at]) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.concatenate([[0], ends])[lists.offsets.to_numpy()].tolist()
        for i, j in zip(bounds, bounds[1:]):
            yield ids[i:j].tobytes()


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker process: its memo serves all tasks that the process runs."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
