"""Damage and repair of conversations by plain recursion."""

import hashlib
import re
import sys
from collections import defaultdict
from functools import lru_cache
from itertools import product
from zlib import crc32

sys.setrecursionlimit(100_000)
MOVES = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
GOAL = re.compile(r"(s?(ua)+)?\Z")


def damaged(rows):
    """conv_id to its (turn, role, text) rows after damage, in order."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        what = crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        kept = out[conv]
        if what == 1:
            text = ""
        elif what == 2:
            text = re.sub(r"[.!?]", "", text)
        elif what == 4:
            role = "user"
        kept += [(turn, role, text)] * (0 if what == 0 else 2 if what == 3 else 1)
    return {c: sorted(x, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest())) for c, x in out.items()}


def faults(rows):
    out, seen = [], set()
    for _, role, text in rows:
        bare = text.strip("\x20\x09\x0a\x0b\x0c\x0d")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def edits(rows, found):
    """(cost, edit initials) by recursion over suffixes."""
    @lru_cache(None)
    def best(i, state, room):
        out = []
        if i == len(rows) and state in ("", "a"):
            out.append((0, ""))
        role, fill = rows[i][1] if i < len(rows) else "", "a" if state == "u" else "u"
        if room:
            cost, rest = best(i, fill, room - 1)
            out.append((cost + 3, "I" + rest))
        if i < len(rows):
            cost, rest = best(i + 1, state, 2)
            out.append((cost + 4, "D" + rest))
            if found[i] not in ("blank", "duplicate"):
                more = 3 if found[i] == "truncated" else 0
                cost, rest = best(i + 1, fill, 2)
                out.append((cost + 3 + more, "R" + rest))
                if not role or (state, role[:1]) in MOVES:
                    cost, rest = best(i + 1, MOVES[state, role[:1]] if role else state, 2)
                    out.append((cost + more, "K" + rest))
        return min(out, default=(10**9, ""))
    return best(0, "", 2)


def every_edit(rows, found):
    """The same by trying all edits, for a few rows."""
    choices = []
    for (_, role, _), fault in zip(rows, found):
        more, kept = (3 if fault == "truncated" else 0), [(4, "D", "")]
        if fault not in ("blank", "duplicate"):
            kept += [(more, "K", role[:1]), (3 + more, "R", "u"), (3 + more, "R", "a")]
        choices += [[(0, "", "")] + [(3 * len(x), "I" * len(x), x) for x in ("u", "a", "ua", "au")], kept]
    choices.append([(0, "", ""), (3, "I", "u"), (3, "I", "a"), (6, "II", "ua"), (6, "II", "au")])
    tried = ((sum(c[0] for c in x), "".join(c[1] for c in x)) for x in product(*choices) if GOAL.match("".join(c[2] for c in x)))
    return min(tried)


def expected(conversations, solve=edits):
    out = []
    for conv, rows in conversations.items():
        found, state, lines, at = faults(rows), "", [], 0
        cost, audit = solve(rows, found)
        for edit in audit:
            if edit in "IR":
                state = "a" if state == "u" else "u"
                lines.append(("assistant" if state == "a" else "user") + ":" + (rows[at][2] if edit == "R" else ""))
            elif edit == "K":
                state = rows[at][1][:1] or state
                lines.append(f"{rows[at][1]}:{rows[at][2]}")
            at += edit != "I"
        turns = [t for t, _, _ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [r[:1] for _, r, _ in rows]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out.append((conv, gaps, *(found.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)
