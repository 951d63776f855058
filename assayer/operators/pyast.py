"""Findings that need a syntax tree: folded strings, capabilities of a file, and what stays unresolved.

Trees are built in Arrow batches, one file at a time; everything else is columns. Files that do not parse count by their text.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Modules and words that show what a file can do.
NETWORK_MODULES = {"urllib", "urllib.request", "requests", "httpx", "aiohttp", "http", "http.client", "socket", "socketserver"}
NETWORK_ROOTS = {"urllib", "requests", "httpx", "aiohttp", "http", "socket"}
EXEC_MODULES = {"subprocess", "ctypes", "marshal", "importlib", "multiprocessing"}
EXEC_ROOTS = {"subprocess", "ctypes", "marshal", "importlib"}
ENCODING_MODULES = {"base64", "zlib", "codecs", "json", "struct", "pickle", "bz2", "lzma", "gzip"}
ENCODING_ROOTS = {"base64", "zlib", "codecs", "json", "struct", "pickle"}
NETWORK_CALLS = ("urlopen", "request", "fetch", "connect", "getaddrinfo", "sendto", "sendall", "sendmsg")
HOME_CALLS = ("expanduser", "Path.home")
HOME_VARIABLES = ("HOME", "USERPROFILE")
TEXT_LOADERS = ("require(", "import ", "fetch(", "xmlhttprequest")
TEXT_NETWORK = ("http", "fetch(", "request", "socket")
TEXT_NETWORK_APIS = (
    "nsurlsession", "nsurlconnection", "datataskwith", "curl_easy_perform", "curl_easy_init", "http.get(", "http.post(", "http.newrequest", "net.dial",
    "net.listen", "reqwest::", "hyper::client", "httpclient", "webclient", "winhttpopen", "internetopen", "cfhoststartinforesolution",
)
TEXT_HOME_APIS = ("nshomedirectory", "os.userhomedir", "dirs::home_dir", "home_dir()", "getpwuid", "shgetfolderpath")
TEXT_HOME_VARIABLES = ('getenv("HOME")', "getenv('HOME')", 'Getenv("HOME")')
TEXT_FILE_APIS = (
    "dataWithContentsOfFile", "contentsOfFile", "stringWithContentsOfFile", "writeToFile", "os.ReadFile", "ioutil.ReadFile", "std::fs::read", "std::ifstream",
    "fopen(", "fread(",
)
TEXT_EXEC_APIS = ("system(", "popen(", "exec.command", "std::process::command", "nsapplescript", "nstask", "createprocess")
COCKTAIL = ("imports_network", "network_calls", "file_io", "imports_encoding", "accesses_home", "atexit", "finalizer")
LEAST_CHARS = 3


def dotted(node: ast.AST) -> str:
    """`a.b.c` of a name or attribute chain; parts that are neither are left out."""
    parts: list[str] = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    if isinstance(node, ast.Name):
        parts.append(node.id)
    return ".".join(reversed(parts))


def in_order(node: ast.AST) -> Iterator[ast.AST]:
    """Nodes of a tree, parents first, as written."""
    stack = [node]
    while stack:
        node = stack.pop()
        yield node
        stack.extend(reversed(list(ast.iter_child_nodes(node))))


def fold(node: ast.AST, names: dict[str, str], depth: int = 0) -> str | None:
    """The constant string that an expression makes of literals, names and simple calls; None for others."""
    if depth > 200:
        return None
    match node:
        case ast.Constant(value=str(text)):
            return text
        case ast.Name(id=name):
            return names.get(name)
        case ast.BinOp(op=ast.Add(), left=left, right=right):
            a, b = fold(left, names, depth + 1), fold(right, names, depth + 1)
            return a + b if a is not None and b is not None else None
        case ast.Call(func=ast.Attribute(attr="join", value=ast.Constant(value=str(between))), args=[ast.List(elts=items)]):
            parts = [fold(i, names, depth + 1) for i in items]
            return between.join(parts) if None not in parts else None
        case ast.Call(func=ast.Attribute(attr="join", value=ast.Constant(value=str())), args=[ast.Name(id=name)]):
            return names.get(name)
        case ast.Call(func=ast.Name(id="chr"), args=[ast.Constant(value=int(code))]):
            return chr(code) if 0 <= code <= 0x10FFFF else None
        case ast.Call(func=ast.Attribute(attr="decode", value=ast.Call(func=ast.Attribute(attr="fromhex"), args=[ast.Constant(value=str(digits))]))):
            try:
                return bytes.fromhex(digits).decode("utf-8", "replace")
            except ValueError:
                return None
        case ast.Call(func=ast.Name(id="list"), args=[ast.Constant(value=str(text))]):
            return text
    return None


def folded(tree: ast.AST) -> list[str]:
    """Strings of over three characters that calls, sums and lists of characters make, each once, in order."""
    names: dict[str, str] = {}
    out: dict[str, None] = {}
    for node in in_order(tree):
        match node:
            case ast.Assign(targets=[ast.Name(id=name)], value=value):
                text = fold(value, names)
                if text is not None and (len(text) > LEAST_CHARS or isinstance(value, ast.Constant)):
                    names[name] = text
            case ast.Call() | ast.BinOp():
                text = fold(node, names)
                if text is not None and len(text) > LEAST_CHARS:
                    out[text] = None
            case ast.List(elts=items) if len(items) >= 4 and all(isinstance(i, ast.Constant) and isinstance(i.value, str) and len(i.value) <= 1 for i in items):
                text = "".join(i.value for i in items)
                if len(text) > LEAST_CHARS:
                    out[text] = None
    return list(out)


def tree_flags(tree: ast.AST) -> set[str]:
    flags: set[str] = set()
    for node in ast.walk(tree):
        modules: list[str] = []
        match node:
            case ast.Import(names=aliases):
                modules = [a.name for a in aliases]
            case ast.ImportFrom(module=str(module)):
                modules = [module]
            case ast.FunctionDef(name="__del__") | ast.AsyncFunctionDef(name="__del__"):
                flags.add("finalizer")
            case ast.Subscript(slice=ast.Constant(value=str(key))) if "environ" in dotted(node.value) and key in HOME_VARIABLES:
                flags.add("accesses_home")
            case ast.Call(func=func, args=args):
                name = dotted(func)
                if any(n in name for n in NETWORK_CALLS):
                    flags.add("network_calls")
                if any(n in name for n in HOME_CALLS):
                    flags.add("accesses_home")
                if "atexit.register" in name or name == "register":
                    flags.add("atexit")
                if "signal.signal" in name:
                    flags.add("signal_handler")
                if name in ("exec", "eval", "compile"):
                    flags.add("exec")
                    if args and not isinstance(args[0], ast.Constant) and isinstance(func, ast.Name):
                        flags.add("exec_of_unknown")
                if name == "open":
                    flags.add("file_io")
                if "environ" in name and any(isinstance(a, ast.Constant) and a.value in HOME_VARIABLES for a in args):
                    flags.add("accesses_home")
        for m in modules:
            root = m.split(".")[0]
            for flag, known, roots in (("imports_network", NETWORK_MODULES, NETWORK_ROOTS), ("imports_exec", EXEC_MODULES, EXEC_ROOTS), ("imports_encoding", ENCODING_MODULES, ENCODING_ROOTS)):
                if m in known or root in roots:
                    flags.add(flag)
            if root == "atexit":
                flags.add("atexit")
    return flags


def trees(files: DataFrame) -> DataFrame:
    """(path, parses, flags, folded) of the Python files among `files` (path, content); flags and folded are empty where a file does not parse."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    tree = ast.parse(content or "")
                    rows.append((path, True, sorted(tree_flags(tree)), folded(tree)))
                except (SyntaxError, ValueError, RecursionError, MemoryError):
                    rows.append((path, False, [], []))
            yield pd.DataFrame(rows, columns=["path", "parses", "flags", "folded"])

    python = files.filter(F.lower("path").endswith(".py")).select("path", "content").dropDuplicates(["path"])
    return python.mapInPandas(run, "path string, parses boolean, flags array<string>, folded array<string>")


def text_flags(content: Column) -> Column:
    """Capabilities by words of the text, in columns only."""
    low = F.lower(content)

    def any_of(source, words):
        found = F.lit(False)
        for w in words:
            found = found | source.contains(w)
        return found

    network = any_of(low, TEXT_NETWORK_APIS) | (any_of(low, TEXT_LOADERS) & any_of(low, TEXT_NETWORK))
    execs = any_of(low, ("child_process", "exec(", *TEXT_EXEC_APIS))
    home = any_of(low, TEXT_HOME_APIS) | any_of(content, TEXT_HOME_VARIABLES)
    flags = (
        (network, "imports_network"), (network, "network_calls"), (execs, "imports_exec"), (execs, "exec"), (home, "accesses_home"),
        (any_of(content, TEXT_FILE_APIS), "file_io"),
    )
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in flags]))


def fingerprints(files: DataFrame, parsed: DataFrame | None = None) -> DataFrame:
    """(path, capabilities, exec_of_unknown) of each file: by syntax tree for Python that parses, by text for all else.

    parsed: the `trees` of the files, where they are at hand already (as for the two functions below).
    """
    t = (trees(files) if parsed is None else parsed).filter("parses").select("path", "flags")
    j = files.select("path", text_flags(F.coalesce("content", F.lit(""))).alias("by_text")).join(t, "path", "left")
    flags = F.array_sort(F.coalesce("flags", "by_text"))
    return j.select("path", F.array_remove(flags, "exec_of_unknown").alias("capabilities"), F.array_contains(flags, "exec_of_unknown").alias("exec_of_unknown"))


def with_folded(files: DataFrame, parsed: DataFrame | None = None) -> DataFrame:
    """Files with what their trees fold to appended to the content, so that text patterns see it."""
    t = (trees(files) if parsed is None else parsed).filter(F.size("folded") > 0).select("path", "folded")
    more = F.concat(F.lit("\n"), F.array_join(F.transform("folded", lambda s: F.concat(F.lit('__folded = "'), s, F.lit('"'))), "\n"))
    return files.join(t, "path", "left").withColumn("content", F.when(F.col("folded").isNotNull(), F.concat("content", more)).otherwise(F.col("content"))).drop("folded")


def folded_findings(files: DataFrame, parsed: DataFrame | None = None) -> DataFrame:
    """(path, source, category, severity, hits) for each file that folds to some string."""
    t = (trees(files) if parsed is None else parsed).filter(F.size("folded") > 0)
    return t.select("path", F.lit("ast-resolver").alias("source"), F.lit("ast:resolved_obfuscation").alias("category"), F.lit("medium").alias("severity"), F.size("folded").alias("hits"))


def unresolved(fingerprinted: DataFrame, findings: DataFrame) -> DataFrame:
    """(path, source, category, severity, hits): what a file can do that no finding explains.

    fingerprinted: path, capabilities, exec_of_unknown; findings: path, category.
    """
    seen = findings.groupBy("path").agg(F.collect_set("category").alias("c"))
    j = fingerprinted.join(seen, "path", "left").withColumn("c", F.coalesce("c", F.array().cast("array<string>")))
    has = lambda name: F.array_contains("capabilities", name)
    credential = F.exists("c", lambda x: x.startswith("behavioral:credential_access"))
    known_network = F.exists("c", lambda x: x.contains("network") | x.contains("exfil") | x.contains("behavioral"))
    compound = credential | F.exists("c", lambda x: x.startswith("compound:"))
    handler = has("atexit") | has("finalizer") | has("signal_handler")
    mixed = F.size(F.array_intersect("capabilities", F.array(*map(F.lit, COCKTAIL))))
    signals = (
        (F.col("exec_of_unknown"), "exec_of_unknown"),
        (has("accesses_home") & has("file_io") & ~credential, "path_construction"),
        (has("network_calls") & has("accesses_home") & ~known_network, "network_with_variable_data"),
        (handler & (has("file_io") | has("network_calls")), "callback_with_side_effects"),
        ((mixed >= 3) & ~compound, "capability_cocktail"),
    )
    cells = [F.when(c, F.lit(f"unresolved:{n}")) for c, n in signals]
    rows = j.select("path", F.explode(F.array_compact(F.array(*cells))).alias("category"))
    return rows.select("path", F.lit("uncertainty-detector").alias("source"), "category", F.lit("medium").alias("severity"), F.lit(1).alias("hits"))
