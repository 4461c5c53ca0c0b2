"""Plain versions of the contracts of the tokenizer alignment: one text at a time."""

import hashlib
from collections import Counter, defaultdict

import sentencepiece
from tokenizers import Tokenizer


def _byte_of():
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in seen]
    return {**{chr(b): b for b in seen}, **{chr(256 + k): b for k, b in enumerate(rest)}}


class Plain:
    def __init__(self, bytes_json, pieces_model):
        self.a = Tokenizer.from_file(bytes_json)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces_model)
        self.byte_of = _byte_of()

    def tokens(self, text):
        """(id, end) of both sides; None if there are none."""
        if not text:
            return None
        whole = (" " + text).encode()
        ids = self.a.encode(" " + text, add_special_tokens=False).ids
        a = [(i, bytes(self.byte_of[c] for c in self.a.id_to_token(i))) for i in ids]
        b = []
        for i in self.b.encode(text):
            piece = self.b.id_to_piece(i)
            b.append((i, bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()))
        if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            return None
        out = []
        for side in (a, b):
            at, ends = 0, []
            for i, x in side:
                at += len(x)
                ends.append((i, at))
            out.append(ends)
        return out


def overlaps(a, b):
    def ranges(side):
        return list(zip([0, *[e for _, e in side]], [e for _, e in side]))
    return {(i, j) for i, (s, e) in enumerate(ranges(a)) for j, (u, v) in enumerate(ranges(b)) if s < v and u < e}


def alignment(docs, plain):
    """Rows (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of (doc_id, text)."""
    found, counts = [], Counter()
    for doc, text in docs:
        sides = plain.tokens(text)
        if sides is None:
            found.append((doc, None, None, [], ""))
            continue
        a, b = sides
        in_a, in_b = {e: i for i, e in a}, {e: i for i, e in b}
        both = sorted(set(in_a) & set(in_b))
        links = [(in_a[e], in_b[e]) for e in both]
        number = {e: k for k, e in enumerate(both)}
        groups = [([], []) for _ in both]
        for side, tokens in enumerate((a, b)):
            k = 0
            for i, e in tokens:
                groups[k][side].append(str(i))
                k += e in number
        groups = [f"{','.join(x)}|{','.join(y)}" for x, y in groups]
        counts.update(links)
        found.append((doc, a, b, links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    top = defaultdict(int)
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    return [(doc, len(a or []), len(b or []), len(links), len(links), sum(counts[x] == top[x[1]] for x in links),
             sum(counts[x] for x in links), digest) for doc, a, b, links, digest in found]
