"""Rules on dense labels that look at the page as a whole: hosts, fences and line edges."""

from __future__ import annotations

import re

import numpy as np

from spanloom.operators.postprocess import Page, absorb_sweeps, edges, fill_pairs, snap

# Hosts that running text may belong to, and (inner, host) pairs.
TEXT_HOSTS = ("markdown", "restructuredtext", "tex")
LOCAL_HOSTS = (("json", "javascript_typescript"), ("xml", "svg"))
LEAST_SUPPORT = 10
ONE_SIDE = 10
FENCE = re.compile("`{3,}")


def host_relabel(labels: np.ndarray, visible: np.ndarray, ids: dict[str, int], declared: str = "") -> np.ndarray:
    """Text goes to the page's one best text host; inner runs go to a host beside them, if well supported or declared.

    visible: which places count as support. Labels without an id don't take part.
    """
    labels = labels.copy()
    count = lambda label: int((visible & (labels == label)).sum())
    text = ids.get("text")
    hosts = sorted(((count(ids[h]), ids[h]) for h in TEXT_HOSTS if h in ids), reverse=True)
    hosts = [h for h in hosts if h[0] >= LEAST_SUPPORT]
    if text is not None and hosts and (len(hosts) == 1 or hosts[0][0] > hosts[1][0]):
        labels[labels == text] = hosts[0][1]
    for inner_name, host_name in LOCAL_HOSTS:
        inner, host = ids.get(inner_name), ids.get(host_name)
        if inner is None or host is None or inner == host or count(host) < LEAST_SUPPORT:
            continue
        cuts = edges(labels)
        names = labels[cuts[:-1]]
        support = np.add.reduceat(visible.astype(np.int64), cuts[:-1]) * (names == host) if len(names) else np.zeros(0, int)
        beside = np.concatenate([[0], support[:-1]]) + np.concatenate([support[1:], [0]]) if len(names) else support
        for k in np.flatnonzero((names == inner) & ((beside >= LEAST_SUPPORT) | (declared == host_name))):
            labels[cuts[k] : cuts[k + 1]] = host
    return labels


def json_like(text: str) -> bool:
    """Whether a piece reads as JSON: bracketed or quoted, a literal or number, or parted by colons or commas among brackets and quotes."""
    t = text.strip()
    if len(t) > 1 and t[0] + t[-1] in ("{}", "[]", '""') or t.lower() in ("true", "false", "null") or re.fullmatch(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?", t):
        return True
    return ":" in t and bool(re.search(r'["{\[]', t)) or "," in t and bool(re.search(r'["{}\[\]]', t))


def local_hosts(text: str, labels: np.ndarray, pairs: list[tuple[int, int, bool]], shortest: int = 3) -> np.ndarray:
    """Inner runs between two runs of their host, or beside a long one, take the host's label; with JSON pairs only what reads as JSON.

    pairs: (inner, host, whether the run must read as JSON). Runs are joined as they
    change, and one that could not change may once a neighbour has grown.
    """
    cuts = edges(labels).tolist()
    names = labels[cuts[:-1]].tolist()
    least = max(shortest, ONE_SIDE)
    k = 0
    while k < len(names):
        for inner, host, as_json in pairs:
            if names[k] != inner:
                continue
            sizes = [cuts[j + 1] - cuts[j] for j in (k - 1, k + 1) if 0 <= j < len(names) and names[j] == host]
            if not sizes or len(sizes) < 2 and sizes[0] < least or as_json and not json_like(text[cuts[k] : cuts[k + 1]]):
                continue
            names[k] = host
            for j in (k + 1, k):
                if 0 < j < len(names) and names[j] == names[j - 1]:
                    del names[j], cuts[j]
            k = max(k - 3, -1)
            break
        k += 1
    return np.repeat(np.array(names, labels.dtype), np.diff(cuts)) if names else labels


def fill_fences(page: Page, labels: np.ndarray, markdown: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of three or more backticks are Markdown; what stands between two on one line gets one label.

    That label is the most frequent there, then the likeliest, then Markdown, then the
    smallest. Without a second run, the word after the first belongs to it. The second
    result says which places are settled by this.
    """
    labels, settled = labels.copy(), np.zeros(len(labels), bool)
    start = 0
    for line in page.text.split("\n"):
        at = 0
        while mark := FENCE.search(line, at):
            a, b = start + mark.start(), start + mark.end()
            close = re.compile(rf"(?<!`)`{{{len(mark[0])},}}").search(line, mark.end())
            if close:
                c, d = start + close.start(), start + close.end()
                kinds, counts = np.unique(labels[b:c], return_counts=True)
                most = kinds[counts == counts.max()]
                support = {int(k): float(page.column(int(k), b, c)[labels[b:c] == k].sum()) for k in most}
                likely = [k for k, v in support.items() if v >= max(support.values()) - 1e-9]
                labels[b:c] = markdown if markdown in likely else min(likely)
                labels[c:d] = markdown
                end = d
            else:
                word = re.compile(r"[^ \t]*").match(line, mark.end())
                end = start + word.end()
                labels[b:end] = markdown
            labels[a:b] = markdown
            settled[a:end] = True
            at = end - start
        start += len(line) + 1
    return labels, settled


def line_edges(text: str, labels: np.ndarray) -> np.ndarray:
    """One or two stray labels at a line's start or end take the label of the two places after or before them.

    Only at real line ends, and on lines of four characters or more.
    """
    labels = labels.copy()
    stops = [k for k, c in enumerate(text) if c == "\n"]
    for start, end in zip([-1, *stops], [*stops, len(text)]):
        start += 1
        if end - start < 4:
            continue
        for rim, step in ((start, 1), (end - 1, -1)):
            if step == 1 and start == 0 or step == -1 and end == len(text):
                continue
            one, two, three = (int(labels[rim + step * k]) for k in (1, 2, 3))
            if one != two and two == three:
                labels[rim] = labels[rim + step] = two
            elif labels[rim] != one and one == two:
                labels[rim] = one
    return labels


def process_page(text: str, labels: np.ndarray, probs: np.ndarray, markdown: int, pairs: list[tuple[int, int, bool]], reach: int = 2, shortest: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """The browsing profile's chain: (labels, step), where step is the number of the last step that changed a place, 0 for none.

    Fences, boundaries, pairs, hosts, short runs, then boundaries, pairs, fences and hosts
    again, then line edges. What a fence settles is left alone by the steps after it.
    """
    page = Page(text, probs)
    settled = np.zeros(len(labels), bool)
    step_of = np.zeros(len(labels), np.int64)

    def fences(x: np.ndarray) -> np.ndarray:
        nonlocal settled
        new, found = fill_fences(page, x, markdown)
        new = np.where(settled, x, new)
        settled = settled | found
        return new

    steps = {
        "fences": fences, "boundaries": lambda x: snap(page, x, reach, shortest), "pairs": lambda x: fill_pairs(page, x, reach),
        "hosts": lambda x: local_hosts(text, x, pairs, shortest), "runs": lambda x: absorb_sweeps(page, x, shortest), "edges": lambda x: line_edges(text, x),
    }
    for number, name in enumerate(("fences", "boundaries", "pairs", "hosts", "runs", "boundaries", "pairs", "fences", "hosts", "edges"), 1):
        new = steps[name](labels) if len(labels) else labels
        if name != "fences":
            new = np.where(settled, labels, new)
        step_of = np.where(new != labels, number, step_of)
        labels = new
    return labels, step_of
