"""Which of many literals a text holds: an index of one rare four-byte piece per literal.

Every literal is filed under the piece of it that is least likely in text. A text's pieces are read as 32-bit words, hashed
into a small table and looked up all at once; only literals whose piece occurs are searched for. One pass, whatever the number
of literals. Literals shorter than a piece are always searched for.
"""

from __future__ import annotations

import numpy as np

_BITS = 20
_FEW = 4  # so many literals are sooner searched for than looked up
_COMMON = {ord(c): i for i, c in enumerate(" etaoinsrhldcumfpgwybv,.kxjqz-_0123456789")}


def _rarity(piece: bytes) -> int:
    return sum(_COMMON.get(b, len(_COMMON)) for b in piece)


def _slots(words: np.ndarray) -> np.ndarray:
    return (words * np.uint32(2654435761)) >> np.uint32(32 - _BITS)


class LiteralIndex:
    """Distinct literals, as bytes in the case and spelling of the texts."""

    def __init__(self, literals: list[bytes]):
        self.literals = list(dict.fromkeys(literals))
        self.short = [i for i, x in enumerate(self.literals) if len(x) < 4]
        self.owners: dict[int, list[int]] = {}
        self.table = np.zeros(1 << _BITS, bool)
        for i, literal in enumerate(self.literals):
            if len(literal) >= 4:
                piece = max((literal[k:k + 4] for k in range(len(literal) - 3)), key=_rarity)
                slot = int(_slots(np.frombuffer(piece, "<u4"))[0])
                self.table[slot] = True
                self.owners.setdefault(slot, []).append(i)

    def candidates(self, text: bytes) -> list[int]:
        """Literals whose piece occurs, and the short ones. Few literals are all candidates."""
        if len(self.literals) <= _FEW:
            return list(range(len(self.literals)))
        slots: set[int] = set()
        for shift in range(min(4, max(0, len(text) - 3))):
            found = _slots(np.frombuffer(text, "<u4", (len(text) - shift) // 4, shift))
            slots.update(found[self.table[found]].tolist())
        return [*self.short, *(i for s in slots for i in self.owners[s])]

    def present(self, text: bytes) -> list[int]:
        return sorted(i for i in self.candidates(text) if self.literals[i] in text)

    def any(self, text: bytes) -> bool:
        return any(self.literals[i] in text for i in self.candidates(text))
