"""Plain restatements to compare with."""

import hashlib


def plain_tree(body, leaf, fan_out):
    leaves = [body[i : i + leaf] for i in range(0, max(len(body), 1), leaf)]
    level = [hashlib.sha256(x).hexdigest() for x in leaves]
    groups = [level[i : i + fan_out] for i in range(0, len(level), fan_out)]
    level = [hashlib.sha256("".join(g).encode()).hexdigest() for g in groups]
    return hashlib.sha256("".join(level).encode()).hexdigest()
