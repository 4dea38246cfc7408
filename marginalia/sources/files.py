"""Folders of documents: listings, markdown with metadata, questions, and converted files."""

from __future__ import annotations

import fnmatch
import os
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import markdown as M
from marginalia.sources import office

# ---- fixed values ---------------------------------------------------------------------------------
SKIPPED_DIRS = frozenset("node_modules bower_components jspm_packages __pycache__ site-packages".split())
AGENT_FILES = frozenset(("AGENTS.md", "CLAUDE.md", "GEMINI.md"))
SOURCE_EXTENSIONS = tuple("pdf docx docm doc pptx pptm ppsx ppsm ppt pps pot odt odp rtf epub html htm txt rst adoc png jpg jpeg".split())
SOURCE_LIMIT = 64 << 20
CHROME = frozenset("script style noscript nav header footer aside form button svg iframe head".split())
CONTENT_IDS = frozenset("main-content content main mw-content-text".split())
# ---------------------------------------------------------------------------------------------------


def ignore_rules(root: str, names: tuple[str, ...] = (".gitignore", ".ignore")) -> list[tuple[str, bool]]:
    """(pattern, whether it takes files back in) of the root's ignore files."""
    out = []
    for n in names:
        p = os.path.join(root, n)
        if os.path.isfile(p):
            with open(p, encoding="utf-8") as f:
                out += [(x.lstrip("!"), x.startswith("!")) for x in (line.strip() for line in f) if x and not x.startswith("#")]
    return out


def ignored(rel: str, rules: list[tuple[str, bool]]) -> bool:
    hit = False
    parts = rel.split("/")
    for pattern, back in rules:
        p = pattern.rstrip("/")
        if "/" in p.strip("/"):
            q = p.strip("/")
            match = fnmatch.fnmatch(rel, q) or fnmatch.fnmatch(rel, q + "/*")
        else:
            match = any(fnmatch.fnmatch(x, p) for x in (parts[:-1] if pattern.endswith("/") else parts))
        if match:
            hit = not back
    return hit


def walk(root: str, extensions: tuple[str, ...] | None = None) -> list[str]:
    """Sorted relative paths; hidden entries, dependency folders, ignored files and links are left out."""
    rules, out = ignore_rules(root), []
    for folder, dirs, files in os.walk(root):
        dirs[:] = sorted(d for d in dirs if not d.startswith(".") and d not in SKIPPED_DIRS and not os.path.islink(os.path.join(folder, d)))
        for f in files:
            rel = os.path.relpath(os.path.join(folder, f), root).replace(os.sep, "/")
            if not f.startswith(".") and not os.path.islink(os.path.join(root, rel)) and not ignored(rel, rules) and (extensions is None or rel.rpartition(".")[2].lower() in extensions):
                out.append(rel)
    return sorted(out)


def discover(root: str) -> list[str]:
    """Markdown files but the agents' instruction files at the root."""
    return [p for p in walk(root, ("md",)) if p not in AGENT_FILES]


def read_markdown(spark: SparkSession, root: str) -> DataFrame:
    """path, id, hash, size, mtime_ns, fm_state, fm_raw (the metadata block with its delimiters), frontmatter (JSON), body, error of every markdown
    file; files that aren't UTF-8 have an error and no body."""
    return _read(spark, root, discover(root))


def _read(spark: SparkSession, root: str, paths: list[str]) -> DataFrame:
    schema = "path string, hash string, size bigint, mtime_ns bigint, fm_state string, fm_raw string, frontmatter string, body string, h1 string, tokens bigint, error string"
    if not paths:
        return spark.createDataFrame([], schema + ", id string")
    base = root.rstrip("/") if "://" in root else os.path.abspath(root)
    literal = [re.sub(r"([\\\[\]{}*?])", r"\\\1", f"{base}/{p}") for p in paths]  # a path is no pattern
    files = spark.read.format("binaryFile").load(literal)
    files = files.withColumn("path", F.expr(f"substring(path, locate({_quoted(base + '/')}, path) + {len(base) + 1})"))

    def parse(batches):
        import hashlib

        for pdf in batches:
            rows = []
            for path, at, size, data in zip(pdf["path"], pdf["mtime_ns"], pdf["size"], pdf["content"]):
                facts = (path, hashlib.sha256(data).hexdigest(), size, at)
                try:
                    text = bytes(data).decode()
                    p = M.parse_document(text)
                    rows.append((*facts, p.state, text[: len(text) - len(p.body)], p.meta, p.body, M.first_h1(p.body), M.tokens(p.body), None))
                except UnicodeDecodeError as e:
                    rows.append((*facts, None, None, None, None, None, None, f"not UTF-8: {e.reason}"))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")]).astype({"tokens": "Int64"})

    # one pass: the content is read, hashed and parsed in the same task, and nothing is joined
    slim = files.select("path", (F.unix_millis("modificationTime") * 1000000).alias("mtime_ns"), F.col("length").alias("size"), "content")
    return slim.mapInPandas(parse, schema).withColumn("id", F.regexp_replace("path", r"\.md$", ""))


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def listing(spark: SparkSession, root: str) -> DataFrame:
    """path, size and mtime_ns (whole milliseconds) of the markdown files, without reading them."""
    rows = [(p, (st := os.stat(os.path.join(root, p))).st_size, st.st_mtime_ns // 1_000_000 * 1_000_000) for p in discover(root)]
    return spark.createDataFrame(rows, "path string, size bigint, mtime_ns bigint")


def sync_folder(spark: SparkSession, root: str, state) -> dict[str, int]:
    """Brings the state's docs table up to date and returns how many files were new, changed, touched,
    unchanged or removed.  Only files whose size or time differ are read; of those only the ones whose
    hash differs count as changed.  Readers see the old version until the new one is complete."""
    from marginalia.operators.sync import changes, merged

    now, old = listing(spark, root), state.read("docs")
    known = old.select("path", "hash", "size", "mtime_ns") if old is not None else spark.createDataFrame([], "path string, hash string, size bigint, mtime_ns bigint")
    quick = now.alias("a").join(known.alias("b"), (F.col("a.path") == F.col("b.path")) & (F.col("a.size") == F.col("b.size")) & (F.col("a.mtime_ns") == F.col("b.mtime_ns")), "left_anti")
    suspects = sorted(r["path"] for r in quick.select("path").collect())  # the listing was made here, too
    fresh = documents(_read(spark, root, suspects))
    hashed = now.join(fresh.select("path", "hash"), "path", "left").join(known.select("path", F.col("hash").alias("known_hash")), "path", "left")
    hashed = hashed.select("path", F.coalesce("hash", "known_hash").alias("hash"), "size", "mtime_ns")
    actions = changes(hashed, known)
    counts = {r["action"]: r["count"] for r in actions.groupBy("action").count().collect()}
    if set(counts) - {"unchanged"} or old is None:
        gone = actions.filter("action = 'removed'").select(F.regexp_replace("path", r"\.md$", "").alias("id"))
        state.commit({"docs": merged(old, fresh, gone) if old is not None else fresh})
    return counts


def documents(parsed: DataFrame) -> DataFrame:
    """The document table of parsed markdown: mapped title (metadata, first heading, file name), description
    and tags; reserved files; text fields of the metadata."""
    g = lambda k: F.get_json_object("frontmatter", f"$.{k}")
    from marginalia.functions import columns as C

    title = C.first_filled(*[g(k) for k in C.TITLE_KEYS])
    # a list, or a text parted by commas or else by blanks
    text = lambda k: g(k)
    as_list = lambda k: F.when(text(k).startswith("["), F.from_json(text(k), "array<string>")).when(text(k).contains(","), F.split(text(k), ",")).otherwise(F.split(F.trim(text(k)), r"\s+"))
    tags = F.coalesce(*[F.filter(F.transform(as_list(k), lambda x: F.trim(x)), lambda x: x != "") for k in C.TAG_KEYS])
    return parsed.select(
        "id", "path", "hash", "size", "mtime_ns", "tokens", C.is_reserved(F.col("id")).alias("reserved"), "fm_state", g("type").alias("type"),
        F.coalesce(title, "h1", C.id_name(F.col("id"))).alias("title"), F.when(title.isNotNull(), "metadata").when(F.col("h1").isNotNull(), "heading").otherwise("name").alias("title_from"),
        C.first_filled(*[g(k) for k in C.DESCRIPTION_KEYS]).alias("description"), g("lang").alias("lang"), g("status").alias("status"), g("updated").alias("updated"),
        *[g(k).alias(k) for k in ("department", "region", "customer", "effective_from", "effective_to", "currency")], g("contract_value").try_cast("bigint").alias("contract_value"), tags.alias("tags"), "frontmatter", "fm_raw", "body", "error",
    )


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """q, doc, lang, doc_lang of evaluation questions in JSON lines; lines without q or doc are dropped."""
    return spark.read.schema("q string, doc string, lang string, doc_lang string").json(path).filter("q is not null and doc is not null")


def write_training(rows: DataFrame, path: str) -> None:
    """JSON lines in folders heldout=true and heldout=false."""
    rows.write.mode("overwrite").partitionBy("heldout").json(path)


# -- conversion --------------------------------------------------------------------------------------


class _Node:
    def __init__(self, tag: str, attrs: dict, parent):
        self.tag, self.attrs, self.parent, self.kids = tag, attrs, parent, []


class _Tree(HTMLParser):
    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        n = _Node(tag, dict(attrs), self.at)
        self.at.kids.append(n)
        if tag not in self.VOID:
            self.at = n

    def handle_startendtag(self, tag, attrs):
        self.at.kids.append(_Node(tag, dict(attrs), self.at))

    def handle_endtag(self, tag):
        n = self.at
        while n and n.tag != tag:
            n = n.parent
        if n and n.parent:
            self.at = n.parent

    def handle_data(self, data):
        self.at.kids.append(data)


def _every(n: _Node):
    stack = [n]
    while stack:
        x = stack.pop()
        yield x
        stack.extend(k for k in reversed(x.kids) if isinstance(k, _Node))


def _text(n) -> str:
    out, stack = [], [n]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        elif x.tag not in CHROME:
            stack.extend(reversed(x.kids))
    return "".join(out)


def html_to_markdown(source: str) -> tuple[str, str | None]:
    """Markdown of a page's main content, and its title.  Page chrome is dropped; every table becomes one
    with pipes.  The content is <main>, role=main, a usual content id, <article>, <body>, or all."""
    t = _Tree()
    t.feed(source)
    t.close()
    all_ = list(_every(t.root))
    pick = (
        lambda n: n.tag == "main", lambda n: n.attrs.get("role") == "main", lambda n: n.attrs.get("id") in CONTENT_IDS, lambda n: n.tag == "article", lambda n: n.tag == "body",
    )
    root = next((n for p in pick for n in all_ if p(n)), t.root)
    title = next((" ".join("".join(k for k in n.kids if isinstance(k, str)).split()) for n in all_ if n.tag == "title"), None)
    md = _markdown(root)
    md = re.sub(r"[ \t]+\n", "\n", md)
    md = re.sub(r"\n{3,}", "\n\n", md).strip()
    return md + "\n", title or None


def _markdown(root) -> str:
    """Children first, by a stack: pages of any depth."""
    done: dict[int, str] = {}
    stack = [(root, False)]
    while stack:
        n, ready = stack.pop()
        if ready:
            done[id(n)] = _own(n, [(k, re.sub(r"\s+", " ", k) if isinstance(k, str) else done.pop(id(k))) for k in n.kids])
        elif n.tag in CHROME:
            done[id(n)] = ""
        elif n.tag == "table":
            done[id(n)] = _table(n)
        elif n.tag == "pre":
            done[id(n)] = f"\n\n```\n{_text(n).strip(chr(10))}\n```\n\n"
        elif n.tag == "code":
            done[id(n)] = f"`{_text(n)}`"
        else:
            stack.append((n, True))
            stack.extend((k, False) for k in n.kids if not isinstance(k, str))
    return done[id(root)]


#: Elements that are blocks of their own.
_BLOCK_TAGS = frozenset("p div section article main body html dl dt dd figure figcaption li tr td".split())


def _own(n: _Node, parts: list[tuple[object, str]]) -> str:
    """Markdown of an element from that of its children."""
    inner, tag = "".join(x for _, x in parts), n.tag
    bare = inner.strip()
    if tag in ("br", "hr"):
        return "\n" if tag == "br" else "\n\n---\n\n"
    if tag in ("strong", "b", "em", "i"):
        mark = "**" if tag in ("strong", "b") else "*"
        return f"{mark}{bare}{mark}" if bare else ""
    if tag == "a":
        return f"[{bare}]({n.attrs['href']})" if bare and n.attrs.get("href") else bare
    if tag == "img":
        return f"![{n.attrs.get('alt') or ''}]({n.attrs.get('src') or ''})"
    if tag in ("ul", "ol"):
        items = [x.strip().replace("\n\n", "\n").replace("\n", "\n  ") for k, x in parts if isinstance(k, _Node) and k.tag == "li"]
        return "\n\n" + "\n".join((f"{i}. " if tag == "ol" else "- ") + x for i, x in enumerate(items, 1)) + "\n\n"
    if tag == "blockquote":
        return "\n\n" + "\n".join("> " + x for x in bare.split("\n")) + "\n\n"
    if m := re.fullmatch("h([1-6])", tag):
        return f"\n\n{'#' * int(m[1])} {bare}\n\n"
    return f"\n\n{bare}\n\n" if tag in _BLOCK_TAGS else inner


def _table(n: _Node) -> str:
    rows = []
    stack = [n]
    while stack:
        x = stack.pop()
        if x.tag == "tr":
            if cells := [" ".join(_text(c).split()).replace("|", "\\|") for c in x.kids if isinstance(c, _Node) and c.tag in ("td", "th")]:
                rows.append(cells)
        else:
            stack.extend(k for k in reversed(x.kids) if isinstance(k, _Node) and k.tag != "table")
    width = max(map(len, rows), default=0)
    if not width:
        return ""
    line = lambda r: "| " + " | ".join(r + [""] * (width - len(r))) + " |"
    return "\n\n" + "\n".join([line(rows[0]), "|" + " --- |" * width, *map(line, rows[1:])]) + "\n\n"


def convert(path: str, data: bytes) -> tuple[str | None, str | None, str | None]:
    """(markdown, title, error) of a file.  HTML, text and office documents are converted by their formats; PDF and
    images need a converter that isn't installed."""
    ext = path.rpartition(".")[2].lower()
    if len(data) > SOURCE_LIMIT:
        return None, None, "too large"
    if ext in ("html", "htm"):
        md, title = html_to_markdown(data.decode("utf-8", "replace"))
        return md, title, None
    if ext in ("txt", "rst", "adoc"):
        return data.decode("utf-8", "replace"), None, None
    readers = {"docx": office.docx, "pptx": office.pptx, "odt": office.odt, "odp": office.odp, "rtf": office.rtf, "epub": lambda d: office.epub(d, html_to_markdown)}
    if ext in readers:
        try:
            return (*readers[ext](data), None)
        except office.OfficeError as e:
            return None, None, str(e)
    return None, None, f"no converter for {ext}"


def convert_files(files: DataFrame) -> DataFrame:
    """path, status (converted or error), format, title, converted and detail of binary files (path,
    content)."""

    def run(batches):
        for pdf in batches:
            rows = []
            for p, d in zip(pdf["path"], pdf["content"]):
                md, title, error = convert(p, bytes(d))
                rows.append((p, "error" if error else "converted", p.rpartition(".")[2].lower(), title, md, error))
            yield pd.DataFrame(rows, columns=["path", "status", "format", "title", "converted", "detail"])

    return files.select("path", "content").mapInPandas(run, "path string, status string, format string, title string, converted string, detail string")


def source_document(path: str, markdown: str, title: str | None) -> dict:
    """The document that stands for a converted file."""
    name = re.sub(r"\.[^.]+$", "", path.rpartition("/")[2])
    return {"type": "Source", "title": title or name, "description": M.first_sentence(markdown) or f"Converted from {path}", "source": {"path": path}}


def site_profile(root: str) -> str:
    """vault, docs-site or folder, by marker files at the root or up to six folders above it, but not above
    a version control root."""
    at = os.path.abspath(root)
    for _ in range(7):
        has = lambda n: os.path.exists(os.path.join(at, n))  # noqa: B023, E731
        if has(".obsidian"):
            return "vault"
        if any(map(has, ("docusaurus.config.js", "docusaurus.config.ts", "docusaurus.config.mjs", "mkdocs.yml", "mkdocs.yaml", "mint.json", "docs.json", "hugo.toml"))):
            return "docs-site"
        if has(".git") or os.path.dirname(at) == at:
            break
        at = os.path.dirname(at)
    return "folder"


def folder_shares(parsed: DataFrame) -> DataFrame:
    """top, docs, conformant, kind of each top folder: conformant documents have valid metadata with a
    type; 0.8 of them make a collection, 0.2 a partial one."""
    top = F.when(F.col("path").contains("/"), F.substring_index("path", "/", 1)).otherwise(".")
    ok = (F.col("fm_state") == "valid") & F.get_json_object("frontmatter", "$.type").isNotNull()
    g = parsed.groupBy(top.alias("top")).agg(F.count(F.lit(1)).alias("docs"), F.count_if(F.coalesce(ok, F.lit(False))).alias("conformant"))
    share = F.col("conformant") / F.col("docs")
    return g.withColumn("kind", F.when(share >= 0.8, "collection").when(share >= 0.2, "partial").otherwise("markdown"))


def best_folder(shares: list[dict]) -> dict | None:
    """The folder to open of measured ones (top, docs, conformant, kind): by kind, then documents; None if
    the first two are alike in both."""
    order = {"collection": 0, "partial": 1, "markdown": 2}
    ranked = sorted(shares, key=lambda r: (order[r["kind"]], -r["docs"], r["top"]))
    if len(ranked) > 1 and all(ranked[0][k] == ranked[1][k] for k in ("kind", "docs")):
        return None
    return ranked[0] if ranked else None


def pending_pages(sources: DataFrame) -> DataFrame:
    """path, hash and page of the pages without text (sources: path, hash, needs_ocr array<int>)."""
    return sources.select("path", "hash", F.explode("needs_ocr").alias("page"))


def with_transcripts(sources: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Sources with needs_ocr less the pages that are transcribed for the same content (hash, page)."""
    left = pending_pages(sources).join(transcripts.select("hash", "page"), ["hash", "page"], "left_anti").groupBy("path").agg(F.array_sort(F.collect_list("page")).alias("needs_ocr"))
    return sources.drop("needs_ocr").join(left, "path", "left").withColumn("needs_ocr", F.coalesce("needs_ocr", F.array().cast("array<int>")))


DATA = ("csv", "tsv", "xlsx", "xlsm", "xls", "ods")


def data_version(root: str) -> tuple[tuple[str, int, int], ...]:
    """path, size and time of the files that tables come from: other tables only where this differs."""
    return tuple((p, (st := os.stat(os.path.join(root, p))).st_size, st.st_mtime_ns) for p in walk(root, DATA))


def datasets(spark: SparkSession, root: str) -> tuple[dict[str, DataFrame], dict[str, str], dict[str, dict[str, str]], list[tuple[str, str]]]:
    """Typed tables of a folder's CSV, TSV and XLSX files by name, the file of each, the headers of their
    columns, and (file, reason) of what couldn't be read.  A name that two files give belongs to the first."""
    from marginalia.sources import tabular

    tables, sources, labels, skipped = {}, {}, {}, []
    for path in walk(root, DATA):
        full, ext = os.path.join(os.path.abspath(root), path), path.rpartition(".")[2].lower()
        try:
            if ext in ("csv", "tsv"):
                got = {tabular.table_name(path): tabular.read_delimited(spark, full, "\t" if ext == "tsv" else ",")}
            elif ext in ("xlsx", "xlsm", "ods"):
                got = tabular.read_workbook(spark, full)
            else:
                skipped.append((path, f"no reader for {ext}"))
                continue
        except Exception as e:  # noqa: BLE001: one bad file leaves the others readable
            skipped.append((path, str(e).split("\n")[0]))
            continue
        for name, (df, head) in got.items():
            if name in tables:
                skipped.append((path, f"table {name} exists"))
            else:
                tables[name], sources[name], labels[name] = tabular.typed(df), path, dict(zip(df.columns, head))
    return tables, sources, labels, skipped


def scaffold(root: str, title: str = "Knowledge") -> list[str]:
    """Writes a root index and an empty vocabulary where they are missing; returns what was written."""
    out = []
    for path, text in (("index.md", f"---\nformat_version: 1\n---\n# {title}\n"), ("_meta/vocabulary.md", "---\nterms: {}\n---\n")):
        full = os.path.join(root, path)
        if not os.path.exists(full):
            os.makedirs(os.path.dirname(full), exist_ok=True)
            with open(full, "w", encoding="utf-8") as f:
                f.write(text)
            out.append(path)
    return out


def new_document(root: str, folder: str, title: str, kind: str, today: str) -> str:
    """Writes a draft document named after its title and returns its path; an existing one is left alone."""
    import json

    from marginalia.functions.columns import fold_text

    name = re.sub(r"[\W_]+", "-", fold_text(title)).strip("-") or "untitled"
    path = f"{folder.strip('/')}/{name}.md".lstrip("/")
    full = os.path.join(root, path)
    if os.path.exists(full):
        raise FileExistsError(path)
    os.makedirs(os.path.dirname(full), exist_ok=True)
    with open(full, "w", encoding="utf-8") as f:
        f.write(f"---\ntype: {json.dumps(kind, ensure_ascii=False)}\ntitle: {json.dumps(title, ensure_ascii=False)}\nstatus: draft\nupdated: {today}\n---\n# {title}\n")
    return path
