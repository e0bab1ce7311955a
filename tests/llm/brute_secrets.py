"""Secret scans spelled out in plain Python."""

import hashlib
import math
import re
from collections import Counter

ASSIGN = re.compile(r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A)
ALLOW = re.compile(
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$|^[0-9]{4}-[0-9]{2}-[0-9]{2}"
    r"|0123456789|(?i:abcdefghij)|(?i:example)|(?i:placeholder)|(?i:x{8})|^[A-Za-z/_=+-]*[0-9]{0,4}$"
)
KINDS = ("assign", "access", "hex", "entropy")


def peak(s, w=20):
    return max((-sum(n / w * math.log2(n / w) for n in Counter(s[i : i + w]).values()) for i in range(len(s) - w + 1)), default=0)


def spelled(spans):
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def scan(text):
    """Counts of the base kinds, digest of the base spans, all spans."""
    t = text or ""
    base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 8]
    base += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    base += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    more = []
    for m in re.finditer("[A-Za-z0-9+/_=-]+", t):
        s = m[0]
        if len(s) < 20 or not re.search("[0-9]", s) or not re.search("[A-Za-z]", s) or ALLOW.search(s):
            continue
        if any(a <= m.start() and m.end() <= b for a, _, b in base):
            continue
        if peak(s) >= (3.0 if re.fullmatch("[0-9a-fA-F]+", s) else 3.75) - 1e-9:
            more.append((m.start(), 3, m.end()))
    return (*(sum(k == kind for _, k, _ in base) for kind in range(3)), hashlib.sha256(spelled(base).encode()).hexdigest(), spelled(base + more))


def redacted(text):
    spans = scan(text)[4]
    if not spans:
        return text
    runs = []
    for a, b in sorted((int(x.split(":")[1]), int(x.split(":")[2])) for x in spans.split(",")):
        if runs and runs[-1][1] >= a:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    out, at = "", 0
    for a, b in runs:
        out, at = out + text[at:a] + "[SECRET]", b
    return out + text[at:]
