"""Text output of bounded results. [SNK-13, GRF-6, GRF-7, WIN-7]"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import lru_cache


@dataclass
class Folder:
    folders: dict[str, Folder] = field(default_factory=dict)
    files: list[str] = field(default_factory=list)

    def count(self) -> int:
        return len(self.files) + sum(f.count() for f in self.folders.values())


def build_tree(paths: Iterable[str]) -> Folder:
    root = Folder()
    for path in sorted(paths):
        *above, name = path.split("/")
        at = root
        for part in above:
            at = at.folders.setdefault(part, Folder())
        at.files.append(name)
    return root


def tree_lines(root: Folder, symbols: dict[str, list[str]] | None = None, *, max_depth: int | None = None, max_files: int | None = None) -> list[str]:
    """A folder line names a chain of only children at once; below ``max_depth`` folders show their counts; after ``max_files``
    files in all the rest is counted."""
    out: list[str] = []
    left = [max_files if max_files is not None else float("inf")]
    hidden = [0]

    def visit(folder: Folder, prefix: str, depth: int) -> None:
        for name in sorted(folder.folders):
            inner, label = folder.folders[name], name
            while not inner.files and len(inner.folders) == 1:
                (step, following), *_ = inner.folders.items()
                inner, label = following, f"{label}/{step}"
            if max_depth is not None and depth >= max_depth:
                out.append(f"{'  ' * depth}{label}/ ({inner.count()} files, {len(inner.folders) + len(inner.files)} entries)")
                continue
            out.append(f"{'  ' * depth}{label}/")
            visit(inner, f"{prefix}{label}/", depth + 1)
        for name in folder.files:
            if left[0] <= 0:
                hidden[0] += 1
                continue
            left[0] -= 1
            out.append(f"{'  ' * depth}{name}")
            out.extend(f"{'  ' * (depth + 1)}{s}" for s in (symbols or {}).get(prefix + name, []))

    visit(root, "", 0)
    if hidden[0]:
        out.append(f"... {hidden[0]} more files")
    return out


def grouped(entries: dict[str, str], indent: str = "  ") -> list[str]:
    """[GRF-7] Lines for path -> text under folder headings chosen so that the fewest characters are written, ties with fewer
    headings."""
    paths = tuple(sorted(entries))

    @lru_cache(None)
    def best(low: int, high: int, base: str, depth: int) -> tuple[int, int, tuple[str, ...]]:
        if low == high:
            return 0, 0, ()
        lead = indent * depth
        line = f"{lead}{paths[low][len(base):]}{entries[paths[low]]}"
        rest = best(low + 1, high, base, depth)
        found = (len(line) + rest[0], rest[1], (line, *rest[2]))
        at = paths[low].find("/", len(base))
        while at >= 0:
            head = paths[low][: at + 1]
            end = low
            while end < high and paths[end].startswith(head):
                end += 1
            if end - low > 1:
                title = f"{lead}{head[len(base):]}"
                inner, after = best(low, end, head, depth + 1), best(end, high, base, depth)
                found = min(found, (len(title) + inner[0] + after[0], 1 + inner[1] + after[1], (title, *inner[2], *after[2])), key=lambda f: f[:2])
            at = paths[low].find("/", at + 1)
        return found

    return list(best(0, len(paths), "", 0)[2])


def search_lines(rows: Iterable) -> list[str]:
    return [f"{r['score']:.3f} {r['file_path']}:{r['start_line']}-{r['end_line']}" + (f" {r['symbol']}" if r["symbol"] else "") for r in rows]


def explain_lines(rows: Iterable) -> list[str]:
    out = []
    for r in rows:
        out.append(f"{r['kind']} {r['name']} {r['file_path']}:{r['start_line']}" + (f"\n  {r['signature']}" if r["signature"] else ""))
        for title in ("callers", "callees"):
            if r[title]:
                out += [f"  {title}:", *grouped({p: "" for p in r[title]}, "    ")]
    return out


def deps_lines(rows: Iterable) -> list[str]:
    found: dict[str, list[str]] = {"callers": [], "callees": []}
    for r in rows:
        found[r["direction"]].append(r["node"])
    return [line for title, nodes in found.items() for line in ([f"{title}:", *[f"  {n}" for n in nodes]] if nodes else [f"{title}: none"])]


def architecture_lines(languages: Iterable, entries: Iterable, targets: Iterable, cycles: Iterable) -> list[str]:
    out = ["languages: " + ", ".join(f"{r['language']} {r['files']}" for r in languages)]
    out += ["entry points:", *[f"  {r['path']}" for r in entries]]
    out += ["modules:", *[f"  {r['from_module']} -> {', '.join(r['targets'])} ({r['bucket']})" for r in targets]]
    pairs = [f"  {r['low']} <-> {r['high']}" for r in cycles]
    return out + (["cycles:", *pairs] if pairs else [])
