"""The rules of (K,E)-frequency, by comparing every window with every other one."""

from __future__ import annotations

from collections import defaultdict

import numpy as np

PAIR = str.maketrans("ACGT", "TGCA")


def revcomp(s):
    return s.translate(PAIR)[::-1]


def mm(a, b):
    return sum(x != y or x == "N" for x, y in zip(a, b))


def windows(files, k):
    """files: list of lists of (name, sequence). Yields (file, sequence, position, window)."""
    for f, seqs in enumerate(files):
        for s, (_, t) in enumerate(seqs):
            for p in range(len(t) - k + 1):
                yield f, s, p, t[p : p + k]


def hits(files, k, errors, both=True):
    """{(file, sequence, position): (plus, minus)}, lists of coordinates; only windows with a hit."""
    places = defaultdict(list)
    for f, s, p, w in windows(files, k):
        places[w].append((f, s, p))
    found = {}

    def near(q):
        return sorted(c for w, cs in places.items() if mm(q, w) <= errors for c in cs)

    for w, own in places.items():
        plus, minus = near(w), near(revcomp(w)) if both else []
        if plus or minus:
            found.update({c: (plus, minus) for c in own})
    return found


def selected(files, intervals):
    return {(f, s, p) for f, seqs in enumerate(files) for s, (name, t) in enumerate(seqs) for n, a, b in intervals if n == name for p in range(a, b)}


def frequency(files, k, errors, both=True, by_file=False, intervals=None):
    """{(file, sequence, position): frequency} where it is not 0."""
    wanted = selected(files, intervals) if intervals is not None else None
    return {c: len({x[0] for x in p + m}) if by_file else len(p) + len(m) for c, (p, m) in hits(files, k, errors, both).items() if wanted is None or c in wanted}


def dense(files, freq):
    return [[[freq.get((f, s, p), 0) for p in range(len(t))] for s, (_, t) in enumerate(seqs)] for f, seqs in enumerate(files)]


def text(v, value):
    if value == "mappability":
        return "%g" % float(np.float32(1) / np.float32(min(v, 65535))) if v else "0"
    return str(min(v, 255 if value == "freq8" else 65535))


def runs(values):
    out, start = [], 0
    for i in range(1, len(values) + 1):
        if i == len(values) or values[i] != values[start]:
            if values[start]:
                out.append((start, i, values[start]))
            start = i
    return out


def files_of(files, freq, names, value, kind, intervals=None):
    """{file name: text} of an encoding."""
    out = {}
    for f, seqs in enumerate(files):
        if intervals is not None and not any(n == name for n, *_ in intervals for name, _ in seqs):
            continue
        lines = []
        for (name, t), values in zip(seqs, dense(files, freq)[f]):
            capped = [min(v, 255 if value == "freq8" else 65535) for v in values]
            if kind == "txt":
                lines += [">" + name, " ".join(text(v, value) for v in values)]
                continue
            before = None
            for a, b, v in runs(capped):
                if kind == "wig":
                    if b - a != before:
                        lines.append(f"variableStep chrom={name} span={b - a}")
                    before = b - a
                    lines.append(f"{a + 1} {text(v, value)}")
                else:
                    lines.append("\t".join([name, str(a), str(b), *["-"] * (kind == "bed"), text(v, value)]))
        out[names[f]] = "".join(x + "\n" for x in lines)
    return out
