"""A unigram piece table from a SentencePiece model file, and the cuts that no piece crosses."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Stands for a space, as SentencePiece writes it.
SPACE = "▁"
#: Texts are cut before a run of SPACE and between letters and others; newlines stand alone.
CHUNK = rf"{SPACE}*\p{{L}}+|{SPACE}*[^{SPACE}\p{{L}}\n]+|{SPACE}+|\n"
#: The score of a character that no piece has: this much below the least piece's.
UNKNOWN_PENALTY = 10.0


@dataclass(frozen=True)
class Pieces:
    """Pieces with id and score (log probability up to a constant), and the ids of the 256 byte
    pieces, which spell characters that no piece has."""

    rows: tuple[tuple[str, int, float], ...]
    byte_ids: tuple[int, ...]
    unknown: float = field(default=float("nan"))

    def __post_init__(self) -> None:
        """unknown, the score of a character that no piece has, is set from the least piece's."""
        if self.unknown != self.unknown:
            object.__setattr__(self, "unknown", min(s for _, _, s in self.rows) - UNKNOWN_PENALTY)

    @property
    def longest(self) -> int:
        return max(len(p) for p, _, _ in self.rows)

    def useful(self) -> Pieces:
        """The pieces without those that no best path can hold: some other pieces of the table
        spell them at a better score, by more than rounding. A step over the vocabulary alone."""
        score, longest, kept = {p: s for p, _, s in self.rows}, self.longest, []
        for piece, i, s in self.rows:
            best = [0.0]
            for end in range(1, len(piece) + 1):
                starts = range(1 if end == len(piece) else max(0, end - longest), end)
                parts = ((k, score.get(piece[k:end], self.unknown if end - k == 1 else None)) for k in starts)
                best.append(max((best[k] + x for k, x in parts if x is not None), default=float("-inf")))
            if len(piece) == 1 or best[-1] <= s + 1e-6 * (abs(s) + 1):
                kept.append((piece, i, s))
        return Pieces(tuple(kept), self.byte_ids, self.unknown)


def load(model_file: str, floor: float = -1e8) -> Pieces:
    """The normal pieces of the file. A score under floor is a placeholder's: such a piece is left
    out, unless it is SPACE or a run of it, which gets the least score of the others.

    Raises ValueError if a piece crosses a cut of CHUNK, since chunks are encoded one by one.
    """
    import regex
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    ids = range(model.get_piece_size())
    normal = [i for i in ids if not (model.is_unknown(i) or model.is_control(i) or model.is_unused(i) or model.is_byte(i))]
    least = min((s for i in normal if (s := model.get_score(i)) > floor), default=0.0)
    scored = [(model.id_to_piece(i), i, model.get_score(i)) for i in normal]
    rows = tuple((p, i, max(s, least)) for p, i, s in scored if s > floor or not p.strip(SPACE))
    crossing = regex.compile(rf"[^{SPACE}]{SPACE}|\p{{L}}[^\p{{L}}]|[^{SPACE}\p{{L}}]\p{{L}}|\n.|.\n", regex.DOTALL)
    if bad := [p for p, _, _ in rows if crossing.search(p)]:
        raise ValueError(f"pieces cross the cuts between chunks: {bad[:5]}")
    return Pieces(rows, tuple(model.piece_to_id(f"<0x{b:02X}>") for b in range(256)))
