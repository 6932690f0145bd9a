"""The trie of rebuilt conversations by plain dictionaries."""

import hashlib
import re
from collections import defaultdict
from zlib import crc32


def rebuilt(rows):
    """conv_id to its turns, from (conv_id, turn, role, text) rows."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(x)] for c, x in own.items()}
    out = {}
    for conv, turns in own.items():
        base = conv - (abs(conv) % 20) * (1 if conv >= 0 else -1)
        h = crc32(str(conv).encode()) % 4
        out[conv] = own.get(base, [])[:h] + turns[h:]
    return out


def expected(sequences):
    members = defaultdict(list)
    for conv, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(conv)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[c] for c in children[node]) or 1
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        saved[node] = sum(saved[c] for c in children[node]) + (len(members[node]) - 1) * words
    out = []
    for node, convs in members.items():
        ends = ",".join(map(str, sorted(c for c in convs if len(sequences[c]) == len(node))))
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(children[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)
