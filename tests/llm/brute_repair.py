"""Plain version of the conversation repair: a shortest-path search per conversation."""

import hashlib
import heapq
import re
import zlib
from collections import defaultdict

VISIBLE = re.compile(r"[^\x20\x09-\x0D]")


def damage(rows):
    """(conv_id, turn, role, text) after the damage, and every conversation there was."""
    out, convs = [], []
    for conv, turn, role, text in rows:
        convs.append(conv)
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        out += [(conv, turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    return out, list(dict.fromkeys(convs))


def order(row):
    key = hashlib.sha256(f"{len(row[2])}:{row[2]}{row[3]}".encode()).digest()[:16]
    return (row[1] is not None, row[1] or 0, row[2].encode(), key)


def cheapest(rows, faults):
    """(cost, edits, repaired lines): every way is a path; states are the row and the initials so far."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    called = {"": "user", "s": "user", "u": "assistant", "a": "user"}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, edits, k, state, lines = heapq.heappop(heap)
        if k == len(rows) and state in ("", "a"):
            return cost, edits, lines
        if (k, state) in done:
            continue
        done.add((k, state))
        name = called[state]
        heapq.heappush(heap, (cost + 2, edits + "I", k, name[0], (*lines, f"{name}:")))
        if k < len(rows):
            role, text = rows[k][2:]
            heapq.heappush(heap, (cost + 3, edits + "D", k + 1, state, lines))
            if faults[k] not in ("blank", "duplicate"):
                late = faults[k] == "truncated"
                heapq.heappush(heap, (cost + 2 + late, edits + "R", k + 1, name[0], (*lines, f"{name}:{text}")))
                if (state, role[:1]) in step:
                    heapq.heappush(heap, (cost + late, edits + "K", k + 1, step[state, role[:1]], (*lines, f"{role}:{text}")))


def repaired(rows, convs):
    of = defaultdict(list)
    for r in rows:
        of[r[0]].append(r)
    out = []
    for conv in convs:
        mine = sorted(of[conv], key=order)
        turns = [r[1] for r in mine if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        seen, faults = set(), []
        for _, _, role, text in mine:
            last = VISIBLE.findall(text)[-1:]
            faults.append("blank" if not last else "duplicate" if (role, text) in seen
                          else "truncated" if last[0] not in ".!?" else None)
            seen.add((role, text))
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        cost, edits, lines = cheapest(mine, faults)
        out.append((conv, gaps, *[faults.count(x) for x in ("blank", "duplicate", "truncated")], illegal, cost, edits,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out
