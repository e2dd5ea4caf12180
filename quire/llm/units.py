"""Cutting text at places that no pre-token of a byte-level BPE pattern spans.

In the pattern ``'s|...| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``
a space can only start a pre-token or stand among other white space. So the place
between a character that is no white space and a following space is always a cut,
and the parts ("units") can be encoded each for itself. Python's ``\\s`` holds
all that the pattern's does, so the cuts taken here are some of the certain ones.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import numpy as np

_WHITE_THEN_SPACE = re.compile(r"\s ")
_CUT = re.compile(r"(?<=\S) ")
#: How the byte-level pattern splits text before merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Units that are encoded as one text.
TOGETHER = 4096
#: Longer units are not kept in caches or tables.
LONGEST = 64
#: Texts are worked on in stretches of about so many characters.
STRETCH = 1 << 20
#: Texts with a whole block of white space go to the tokenizers library: in runs of 1,000,000 characters tiktoken's matcher runs out of stack.
BLOCK = 250_000


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def stretches(text: str, size: int = STRETCH) -> Iterator[str]:
    """``text`` in stretches that end at certain cuts, so that no list of all units of a long text is made."""
    start = 0
    while len(text) - start > size and (cut := _CUT.search(text, start + size)):
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def units(text: str) -> list[str]:
    """The units of a stretch; all but the first begin with a space."""
    parts = _CUT.split(text) if _WHITE_THEN_SPACE.search(text) else text.split(" ")
    return [parts[0], *[" " + x for x in parts[1:]]]


class UnitEncoder:
    """Encodes many units in few calls of the tokenizers library.

    Units that begin with a space and end in no white space may stand one after
    the other in one text: every place between two of them is a certain cut. Whose
    a token is follows from the tokens' bytes.

    Where ids are in the order of the merges, rank-based BPE gives the same ids,
    and tiktoken's is several times faster on words met for the first time; texts
    that hold an added token or a very long run of white space go to the tokenizers library all the same.
    """

    def __init__(self, tokenizer) -> None:
        self.tokenizer = tokenizer
        spec = json.loads(tokenizer.to_str())
        sizes = {v: len(k) for k, v in spec["model"]["vocab"].items()}  # a letter a byte
        sizes |= {x["id"]: len(x["content"].encode()) for x in spec["added_tokens"]}
        self.sizes = np.zeros(max(sizes, default=-1) + 1, np.int64)
        self.sizes[list(sizes)] = list(sizes.values())
        self.added = [x["content"] for x in spec["added_tokens"]]
        self.by_rank = self._ranked(spec)

    def _ranked(self, spec: dict) -> Callable[[str], list[int]] | None:
        import tiktoken

        letters, vocab = byte_letters(), spec["model"]["vocab"]
        merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
        if merged != sorted(set(merged)) or merged and min(merged) < 256 or any(vocab.get(c, 256) >= 256 for c in letters):
            return None
        ranks = {bytes(letters[c] for c in k): v for k, v in vocab.items() if k not in set(self.added)}
        return tiktoken.Encoding("units", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def ranked(self, text: str) -> bool:
        """Whether ``by_rank`` encodes ``text`` as the library does."""
        if self.by_rank is None or any(a in text for a in self.added):
            return False
        return not any(text[i : i + BLOCK].isspace() for i in range(0, len(text) - BLOCK + 1, BLOCK))

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        slow = [i for i, t in enumerate(texts) if not self.ranked(t)]
        found = dict(zip(slow, self.tokenizer.encode_batch_fast([texts[i] for i in slow], add_special_tokens=False)))
        return [np.array(found[i].ids if i in found else self.by_rank(t), "<u4") for i, t in enumerate(texts)]

    def _parts(self, many: list[str]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
        """(positions in ``many``, their ids one after the other, where each begins and the last ends)."""
        joined = [i for i, u in enumerate(many) if u[:1] == " " and not u[-1].isspace()]
        held = set(joined)
        alone = [i for i in range(len(many)) if i not in held]
        groups = [joined[i : i + TOGETHER] for i in range(0, len(joined), TOGETHER)]
        for own, ids in zip(groups, self._whole(["".join([many[i] for i in g]) for g in groups])):
            ends = np.cumsum(self.sizes[ids])
            wanted = np.cumsum([len(many[i].encode()) for i in own])
            cuts = np.searchsorted(ends, wanted) + 1
            if not np.array_equal(ends[cuts - 1], wanted):
                raise ValueError("a token spans two units: this tokenizer's texts can't be cut")
            yield own, ids, np.concatenate([[0], cuts])
        for i, ids in zip(alone, self._whole([many[i] for i in alone])):
            yield [i], ids, np.array([0, len(ids)])

    def counts(self, many: list[str]) -> list[int]:
        out = [0] * len(many)
        for own, _, cuts in self._parts(many):
            for i, n in zip(own, np.diff(cuts).tolist()):
                out[i] = n
        return out

    def ids(self, many: list[str]) -> list[bytes]:
        """The ids of each as little-endian unsigned numbers of 32 bits."""
        out = [b""] * len(many)
        for own, ids, cuts in self._parts(many):
            raw, at = ids.tobytes(), (4 * cuts).tolist()
            for i, a, b in zip(own, at, at[1:]):
                out[i] = raw[a:b]
        return out

    def stretch_ids(self, stretch: str, cache: BoundedCache) -> bytes:
        """The ids of a stretch, as ``ids`` gives them.

        By rank it is encoded whole, as looking up all its units takes longer than that. For the library the units that
        ``cache`` doesn't hold yet are enough.
        """
        if self.ranked(stretch):
            return np.array(self.by_rank(stretch), "<u4").tobytes()
        return b"".join(cache.values_of(units(stretch), self.ids))


class BoundedCache(dict):
    """A dict that is emptied when it is full; ``base`` stays in it always. Long keys are not kept."""

    def __init__(self, limit: int, base: dict | None = None):
        super().__init__(base or {})
        self.base, self.limit = base or {}, limit + len(base or {})

    def add(self, new: dict) -> None:
        if len(self) + len(new) > self.limit:
            self.clear()
            self.update(self.base)
        self.update(new)

    def values_of(self, keys: list, make: Callable[[list], list]) -> Iterator:
        """The values of ``keys`` in order; ``make`` gives those of a list of keys that aren't held yet."""
        if missing := [k for k in set(keys) if k not in self]:
            new = dict(zip(missing, make(missing), strict=True))
            long = {k: new.pop(k) for k in missing if len(k) > LONGEST}
            if len(self) + len(new) > self.limit:
                new |= {k: self[k] for k in set(keys) if k not in new and k not in long}
            self.add(new)
            if long:
                return (long[k] if k in long else self[k] for k in keys)
        return map(self.__getitem__, keys)
