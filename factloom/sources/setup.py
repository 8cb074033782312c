"""Setting up a tree: its configuration folder, the ignore rule for it, and a managed block in an instruction file."""

from __future__ import annotations

import os

CONFIG_DIR, CONFIG_FILE = ".factloom", "config.toml"
BEGIN, END = "<!-- factloom:start -->", "<!-- factloom:end -->"
SNIPPET = f"""{BEGIN}
Look up declarations and their uses before reading whole files:
`python -m factloom --store .factloom/store symbol NAME`, `refs NAME`, `context NAME --tokens N`.
Answers list `exact`, `scoped` and `name_match` evidence; an empty list is no proof that nothing uses a name.
{END}
"""
DEFAULT_CONFIG = """[index]
exclude = []
max_file_size_kb = 1024

[languages]
enabled = ["php", "typescript"]

[queries]
token_budget = 4000
max_depth = 2
limit = 50
"""


def with_block(text: str, block: str = SNIPPET) -> str:
    """text with its managed block replaced, or the block appended; more than one block, or half of one, is an error."""
    starts, ends = text.count(BEGIN), text.count(END)
    if starts != ends or starts > 1:
        raise ValueError("the file's managed block isn't whole")
    if not starts:
        gap = "" if not text or text.endswith("\n\n") else "\n" if text.endswith("\n") else "\n\n"
        return text + gap + block
    a, b = text.index(BEGIN), text.index(END) + len(END)
    if text.index(END) < a:
        raise ValueError("the file's managed block isn't whole")
    return text[:a] + block.rstrip("\n") + text[b:]


def _write(path: str, text: str) -> None:
    """Whole or not at all."""
    with open(path + ".new", "w", encoding="utf-8", newline="") as f:
        f.write(text)
    os.replace(path + ".new", path)


def _read(path: str) -> str | None:
    try:
        with open(path, encoding="utf-8", newline="") as f:
            return f.read()
    except FileNotFoundError:
        return None


def init(root: str, snippet_file: str | None = None) -> dict:
    """created and modified paths in byte order; an existing configuration stays as it is, and a second run changes nothing."""
    created, modified = [], []
    folder = os.path.join(root, CONFIG_DIR)
    if snippet_file is not None and (os.path.isabs(snippet_file) or ".." in snippet_file.split("/")):
        raise ValueError("the snippet file must lie in the tree")
    block = None
    if snippet_file is not None:
        old = _read(os.path.join(root, snippet_file))
        block = with_block(old or "")
    if not os.path.isdir(folder):
        os.mkdir(folder)
        created.append(CONFIG_DIR + "/")
    if not os.path.exists(os.path.join(folder, CONFIG_FILE)):
        _write(os.path.join(folder, CONFIG_FILE), DEFAULT_CONFIG)
        created.append(f"{CONFIG_DIR}/{CONFIG_FILE}")
    rules = _read(os.path.join(root, ".gitignore"))
    if CONFIG_DIR + "/" not in (rules or "").splitlines():
        _write(os.path.join(root, ".gitignore"), (rules or "") + ("" if not rules or rules.endswith("\n") else "\n") + CONFIG_DIR + "/\n")
        (modified if rules is not None else created).append(".gitignore")
    if block is not None and block != old:
        _write(os.path.join(root, snippet_file), block)
        (modified if old is not None else created).append(snippet_file)
    order = lambda paths: sorted(paths, key=str.encode)
    return {"schema_version": 1, "created": order(created), "modified": order(modified), "snippet_file": snippet_file}
