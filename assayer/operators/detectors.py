"""Detectors over text files: content to findings (path, ordinal, source, category, severity, hits), on demand with message, values and places.

All patterns of a file are counted in one projection; a second one turns counts into an array of findings, which is
exploded. Nothing shuffles. Places are looked for only where something was found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions import arrays, paths, places
from assayer.operators import patterns as P

#: Patterns of which the number of matches counts, and those of which only presence does.
COUNTED = {
    "char_list": P.CHAR_LIST, "objc": P.OBJC_STRING_ARRAY, "cpp": P.CPP_STRING_CONCAT, "eval_exec": P.EVAL_EXEC, "fromcharcode": P.FROMCHARCODE, "atob": P.ATOB,
    "js_obfusc": P.JS_OBFUSC, "packed_js": P.PACKED_JS, "hex_escape": P.HEX_ESCAPE, "selectors": P.VARIATION_SELECTOR, "private_use": P.PRIVATE_USE,
    "btc": P.BTC, "eth": P.ETH, "shellcode": P.SHELLCODE, "aws": P.AWS_KEY, "github": P.GITHUB_TOKEN, "api_key": P.API_KEY,
    "sensitive_path": P.SENSITIVE_PATH, "sensitive_literal": P.SENSITIVE_LITERAL, "sensitive_bare": P.SENSITIVE_BARE,
}
PRESENT = {
    "decoder": P.CODEPOINT_DECODER, "exec_compile": P.EXEC_COMPILE, "xor": P.XOR_LAMBDA, "marshal": P.MARSHAL_LOADS, "nested": P.NESTED_DECODE, "rot13": P.ROT13,
    "embedded_pe": P.EMBEDDED_PE, "data_uri": P.DATA_URI, "private_key": P.PRIVATE_KEY, "exfil_py": P.EXFIL_PYTHON, "exfil_js": P.EXFIL_JS,
    "exfil_poly": P.EXFIL_POLYGLOT, "git_py": P.GIT_PYTHON, "git_js": P.GIT_JS, "git_write": P.GIT_WRITE, "curl_pipe": P.CURL_PIPE_SHELL,
    "remote_fetch": P.REMOTE_FETCH, "install_exec": P.INSTALL_CODE_EXEC, "getattr_concat": P.GETATTR_CONCAT, "getattr_builtins": P.GETATTR_BUILTINS,
    "dict_builtins": P.DICT_BUILTINS, "global_computed": P.GLOBAL_COMPUTED,
}
#: Texts of which one at least is in every match: plain searches, so most files never reach the pattern.
NEEDED = {
    "char_list": ("[",), "objc": ("@[",), "cpp": ("+",), "eval_exec": ("eval", "exec"), "fromcharcode": ("fromCharCode",), "atob": ("atob",), "js_obfusc": ("_0x",),
    "packed_js": ("eval",), "hex_escape": ("\\x",), "eth": ("0x",), "shellcode": ("\\x",), "aws": ("AKIA",), "github": ("ghp_", "ghs_"), "decoder": ("codePointAt",),
    "exec_compile": ("compile",), "xor": ("^",), "marshal": ("marshal",), "nested": ("b64decode",), "rot13": ("codecs",), "embedded_pe": ("\\x", 'b"MZ"', "b'MZ'"),
    "data_uri": (";base64,",), "private_key": ("PRIVATE KEY",), "git_py": ("subprocess", "os.system"), "git_js": ("exec", "spawn"), "git_write": ("commit", "push", "add"),
    "curl_pipe": ("curl", "wget"), "remote_fetch": ("url", "requests", "httpx"), "install_exec": ("exec", "eval"), "getattr_concat": ("getattr",),
    "getattr_builtins": ("getattr",), "dict_builtins": ("globals", "vars"), "global_computed": ("global",), "sensitive_bare": ("'.", '".'),
}
#: Endings that sensitive paths have.
SENSITIVE_END = r"(?i)\.(?:ssh|aws|npmrc|gitconfig|gnupg|env|docker|kube|yarnrc|pypirc|netrc|config/gh)|id_rsa|id_ed25519|credentials|local\s*storage|cookies\.sqlite|login\s*data"
#: Cheaper patterns that match wherever the full one does: most positions of a text fail at their first character.
NEEDED_PATTERN = {
    "api_key": r"[:=]\s*[\"']?[A-Za-z0-9_\-/+=]{20}",
    "btc": r"[13][a-km-zA-HJ-NP-Z1-9]{25}",
    "selectors": r"[\x{FE00}-\x{FE0F}]",
    "private_use": r"[\x{E0100}-\x{E01EF}]",
    "sensitive_path": SENSITIVE_END,
    "sensitive_literal": SENSITIVE_END,
}
#: What only counts beside a sensitive path, a dynamic import or an install script is looked for in such files only.
BESIDE = {
    "sensitive": ("exfil_py", "exfil_js", "exfil_poly", "git_py", "git_js", "git_write"),
    "in_install": ("curl_pipe", "remote_fetch", "install_exec"),
    "dynamic_imports": ("exec_compile",),
}
#: What evidence of a finding looks for: the first of these patterns that matches, by the names above.
LOOKED_FOR = {
    "obfuscation:char_list_join": ("char_list",), "obfuscation:objc_string_array": ("objc",), "obfuscation:cpp_string_concat_chain": ("cpp",), "obfuscation:eval_exec": ("eval_exec",),
    **{f"obfuscation:{k}": (k,) for k in ("fromcharcode", "atob", "js_obfusc", "packed_js", "hex_escape", "marshal", "rot13")},
    "obfuscation:unicode_decoder": ("decoder",), "obfuscation:xor_transform": ("xor",), "obfuscation:import_exec_chain": ("exec_compile", "eval_exec"), "obfuscation:nested_decode": ("nested",),
    "crypto:btc_addr": ("btc",), "crypto:eth_addr": ("eth",), "payload:embedded_pe": ("embedded_pe",), "payload:shellcode": ("shellcode",), "payload:data_uri": ("data_uri",),
    "secret:private_key": ("private_key",), "secret:aws_key": ("aws",), "secret:github_token": ("github",), "secret:api_key": ("api_key",),
    **{c: ("sensitive_path", "sensitive_literal", "sensitive_bare") for c in (
        "behavioral:install_hook_credential_exfil", "behavioral:credential_access_exfil", "behavioral:bulk_credential_access", "behavioral:migration_credential_theft",
    )},
    "behavioral:git_exfiltration": ("git_py", "git_js"), "obfuscation:indirect_exec:getattr_concat": ("getattr_concat",), "obfuscation:indirect_exec:getattr_builtins": ("getattr_builtins",),
    "obfuscation:indirect_exec:dict_builtins": ("dict_builtins",), "obfuscation:indirect_exec:global_computed": ("global_computed",), "supply_chain:install_dropper": ("curl_pipe", "remote_fetch"),
    "compound:credential_theft_with_evasion": ("getattr_concat", "getattr_builtins", "dict_builtins", "global_computed"),
}
#: Places and values that evidence keeps of a finding, code points of a value, and of one in a message.
FIRST, VALUE, VALUE_SHOWN = 5, 200, 60
FINDING = "array<struct<source: string, category: string, severity: string, hits: int>>"
_NONE = "CAST(array() AS array<string>)"


def _readable(run: Column) -> Column:
    """Whether a base64 run decodes to more than 20 bytes, over half of them printable. Padding may be too long, not too short."""
    data = F.rtrim(run, F.lit("="))
    need = F.pmod(-F.length(data), F.lit(4))
    whole = (need < 3) & (F.length(run) - F.length(data) >= need)
    raw = F.when(whole, F.try_to_binary(F.concat(data, F.repeat(F.lit("="), need)), F.lit("base64")))
    text = F.decode(raw, "ISO-8859-1")
    return F.coalesce((F.length(text) > 20) & (2 * F.regexp_count(text, F.lit(r"[\x20-\x7E]")) > F.length(text)), F.lit(False))


def _base64_blob(content: Column) -> Column:
    """Whether some base64 run is readable."""
    return content.rlike(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40}") & F.exists(F.regexp_extract_all(content, F.lit(P.BASE64), 0), _readable)


def _any(source: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | source.contains(w)
    return found


def _measure(files: DataFrame) -> DataFrame:
    c, low = F.col("content"), F.lower("path")
    extract = lambda guard, pattern: F.when(guard, F.regexp_extract_all(c, F.lit(pattern), 1)).otherwise(F.expr(_NONE))
    dynamic = F.array_union(extract(c.contains("__import__"), P.DUNDER_IMPORT), extract(c.contains("importlib"), P.IMPORTLIB_MODULE))
    listed = lambda names: F.array_compact(F.array(*[F.when(c.contains(n), n) for n in names]))
    imports = (
        F.when(low.endswith(".py"), listed(P.PYTHON_IMPORTS))
        .when(paths.ends_with_any(low, (".js", ".ts", ".jsx", ".tsx")), listed(P.JS_IMPORTS))
        .when(low.endswith(".go"), listed(P.GO_IMPORTS))
        .otherwise(F.expr(_NONE))
    )
    quoted = c.contains('"') | c.contains("'")
    long_lines = F.filter(F.regexp_extract_all(c, F.lit(P.LONG_STRING), 0), lambda s: ~s.contains("\n"))

    def needed(k):
        if k in NEEDED_PATTERN:
            return c.rlike(NEEDED_PATTERN[k])
        return _any(c, NEEDED[k]) if k in NEEDED else F.lit(True)

    late = {k for names in BESIDE.values() for k in names}
    counted = {k: F.when(needed(k), F.regexp_count(c, F.lit(p))).otherwise(0) for k, p in COUNTED.items()}
    m = files.select(
        *files.columns,
        *[n.alias(f"n_{k}") for k, n in counted.items()],
        *[(needed(k) & c.rlike(p)).alias(f"is_{k}") for k, p in PRESENT.items() if k not in late],
        _base64_blob(c).alias("is_base64"),
        F.array_intersect(dynamic, F.array(*map(F.lit, P.ENCODING_MODULES_DYNAMIC))).alias("dynamic"),
        imports.alias("imports"),
        extract(c.contains("://"), P.HARDCODED_IP).alias("urls"),
        extract(c.rlike(r"""\(\s*["']\d"""), P.SOCKET_IP).alias("sockets"),
        F.when(quoted & (F.length(c) > 500), F.size(long_lines)).otherwise(0).alias("n_long"),
        (c.contains("struct.pack") & c.contains("SOCK_DGRAM") & c.contains(".sendto(")).alias("is_dns"),
        c.contains("migrations.RunPython").alias("is_migration"),
        paths.is_test_path(F.col("path")).alias("in_test"),
        paths.is_data_file(F.col("path")).alias("in_data"),
        paths.is_install_script(F.col("path")).alias("in_install"),
        (~paths.extension(F.col("path")).isin(*P.COMPILED_EXTENSIONS)).alias("interpreted"),
    )
    m = m.withColumns({"sensitive": F.col("n_sensitive_path") + F.col("n_sensitive_literal") + F.col("n_sensitive_bare"), "dynamic_imports": F.size("dynamic") > 0})
    beside = {"sensitive": F.col("sensitive") > 0, "in_install": F.col("in_install"), "dynamic_imports": F.col("dynamic_imports")}
    return m.withColumns({f"is_{k}": beside[where] & needed(k) & c.rlike(PRESENT[k]) for where, names in BESIDE.items() for k in names})


def _finding(when: Column, category, severity, hits=None, source: str = "source-heuristic") -> Column:
    category = F.lit(category) if isinstance(category, str) else category
    severity = F.lit(severity) if isinstance(severity, str) else severity
    hits = F.lit(1) if hits is None else hits.cast("int")
    return F.when(when, F.struct(F.lit(source).alias("source"), category.alias("category"), severity.alias("severity"), hits.alias("hits"), F.lit(0).alias("nth")))


def _looked_for(category: Column) -> Column:
    """The pattern whose places are the evidence of a category, null for none."""
    c = F.col("content")
    any_of = lambda names: F.lit("|".join(rf"\Q{n}\E" for n in names))
    there = lambda k: F.col(f"n_{k}") > 0 if k in COUNTED else F.col(f"is_{k}")
    modules = f"(?:{'|'.join(P.ENCODING_MODULES_DYNAMIC)})"
    low = F.lower("path")
    out = (
        F.when(category == "obfuscation:base64", F.concat(F.lit(r"\Q"), F.element_at(F.filter(F.regexp_extract_all(c, F.lit(P.BASE64), F.lit(0)), _readable), 1), F.lit(r"\E")))
        .when(category == "obfuscation:invisible_unicode", f"{P.VARIATION_SELECTOR}|{P.PRIVATE_USE}")
        .when(category == "obfuscation:dynamic_import", "|".join(x.replace(r"(\w+)", modules) for x in (P.DUNDER_IMPORT, P.IMPORTLIB_MODULE)))
        .when(category == "import:suspicious", F.when(low.endswith(".py"), any_of(P.PYTHON_IMPORTS)).when(low.endswith(".go"), any_of(P.GO_IMPORTS)).otherwise(any_of(P.JS_IMPORTS)))
        .when(category == "payload:long_string", P.LONG_STRING)
        .when(category == "behavioral:dns_exfiltration", r"\.sendto\(")
    )
    for name, keys in LOOKED_FOR.items():
        out = out.when(category == name, F.coalesce(*[F.when(there(k), F.lit(COUNTED.get(k) or PRESENT[k])) for k in keys]))
    return out


def _with_evidence(m: DataFrame) -> DataFrame:
    """Rows with findings (array): each finding with message, values and places. What a secret says is left out."""
    c = F.col("content")
    m = m.withColumns({k: F.when(F.size(found) > 0, places.places(c, p)) for k, found, p in (("url_at", "urls", P.HARDCODED_IP), ("socket_at", "sockets", P.SOCKET_IP))})

    # One column a step: nested in one expression, the types of the steps would be worked out again at each level.
    get = lambda name: lambda i: F.get(name, i)
    pattern, hits, gaps, at, feeds, begin = map(get, ("patterns", "hits", "gaps", "starts", "feeds", "begins"))
    most = lambda i: F.when(F.get("findings", i)["category"] == "payload:long_string", 1 << 30).otherwise(FIRST)
    steps = {
        "patterns": F.transform("findings", lambda f: F.when(f["nth"] == 0, _looked_for(f["category"]))),
        "hits": F.transform("patterns", lambda p, i: F.slice(F.regexp_extract_all(c, p, F.lit(0)), F.lit(1), most(i))),
        "gaps": F.transform("patterns", lambda p, i: F.split(c, p, most(i) + 1)),
        "starts": F.transform("hits", lambda h, i: places.starts(h, gaps(i))),
        "feeds": F.transform("hits", lambda h, i: places.feeds_before(h, gaps(i))),
        "begins": F.transform("hits", lambda h, i: places.begins(h, gaps(i), at(i))),
        "spots": F.transform("hits", lambda h, i: places.placed(h, gaps(i), at(i), feeds(i), begin(i))),
    }
    for name, make in steps.items():
        m = m.withColumn(name, make)

    # Long strings are those on one line; addresses have places of their own.
    def spots(f, i):
        own = F.coalesce(F.get("spots", i), F.expr(places.NONE))
        one_line = F.slice(F.filter(own, lambda x: ~x["hit"].contains("\n")), 1, FIRST)
        address = F.array(F.coalesce(F.get("url_at", f["nth"] - 1), F.get("socket_at", -f["nth"] - 1)))
        return F.when(f["nth"] != 0, address).when(f["category"] == "payload:long_string", one_line).otherwise(own)

    def shown(f, i):
        secret = f["category"].startswith("secret:")
        hide = lambda x: F.struct(x["start"], x["line"], x["column"], F.concat(F.left(x["hit"], F.lit(4)), F.lit("…")).alias("hit"), F.lit("…").alias("excerpt"))
        bound = lambda x: F.struct(x["start"], x["line"], x["column"], F.left(x["hit"], F.lit(VALUE)).alias("hit"), x["excerpt"])
        return F.transform(F.get("spots", i), lambda x: F.when(secret, hide(x)).otherwise(bound(x)))

    def values(f, i):
        at = F.get("places", i)
        given = (
            F.when(f["category"] == "import:suspicious", F.col("imports"))
            .when(f["category"] == "obfuscation:dynamic_import", F.col("dynamic"))
            .when(f["category"] == "obfuscation:combined", F.array(f["hits"].cast("string")))
            .when(f["nth"] > 0, F.array(F.get("urls", f["nth"] - 1)))
            .when(f["nth"] < 0, F.array(F.get("sockets", -f["nth"] - 1), F.regexp_extract(F.get(at, F.lit(0))["hit"], P.SOCKET_IP, 2)))
        )
        return F.transform(F.slice(F.coalesce(given, F.array_distinct(F.transform(at, lambda x: x["hit"]))), 1, FIRST), lambda v: F.left(v, F.lit(VALUE)))

    def told(f, i):
        at, said = F.get("places", i), F.get("values", i)
        line = F.coalesce(F.concat(F.lit(":"), F.get(at, F.lit(0))["line"].cast("string")), F.lit(""))
        times = F.when(f["hits"] > 1, F.concat(F.lit(" ("), f["hits"].cast("string"), F.lit(" times)"))).otherwise("")
        first = F.when(F.size(said) > 0, F.concat(F.lit(": "), F.array_join(F.transform(said, lambda v: F.left(v, F.lit(VALUE_SHOWN))), ", "))).otherwise("")
        message = F.concat(F.translate(F.regexp_replace(f["category"], "^[^:]*:", ""), "_:", "  "), F.lit(" in "), F.col("path"), line, times, first)
        return f.withField("message", message).withField("values", said).withField("places", at)

    for name, make in (("spots", spots), ("places", shown), ("values", values), ("findings", told)):
        m = m.withColumn(name, F.transform("findings", make))
    return m


def observations(files: DataFrame, *, evidence: bool = False) -> DataFrame:
    """Findings of files (path, content): path, ordinal (from 1, in the order of detectors), source, category, severity, hits.

    evidence: with message, values (what was matched, imported or called, FIRST of them) and places (the FIRST ones, see functions.places) too.
    """
    m = _measure(files.select("path", F.coalesce("content", F.lit("")).alias("content")))
    n, has, col = (lambda k: F.col(f"n_{k}")), (lambda k: F.col(f"is_{k}")), F.col
    m = m.withColumns(
        {
            "evals": F.when(col("interpreted"), n("eval_exec")).otherwise(0),
            "invisible": n("selectors") + n("private_use"),
            "exfil": has("exfil_py") | has("exfil_js") | has("exfil_poly"),
        }
    )
    one = lambda b: b.cast("int")
    early = one(has("base64")) + sum(one(n(k) > 0) for k in ("char_list", "objc", "cpp")) + one(col("evals") > 0) + sum(one(n(k) > 0) for k in ("fromcharcode", "atob", "js_obfusc", "packed_js"))
    m = m.withColumn("early", early)
    unseen = F.when(col("in_data") & ~has("decoder"), "info").when(has("decoder") | (col("evals") > 0), "critical").otherwise("high")
    m = m.withColumn("unseen", unseen)
    indicators = (
        col("early") + one((n("hex_escape") > 0) & (col("early") > 0)) + one((col("invisible") > 50) & (col("unseen") != "info")) + one(has("decoder"))
        + one(col("dynamic_imports")) + one(has("xor")) + one(has("marshal")) + one(has("rot13"))
    )
    m = m.withColumn("indicators", indicators)
    likely_data = paths.ends_with_any(F.lower("path"), P.LIKELY_DATA_EXTENSIONS) | col("in_test") | col("in_data")
    key_library = F.lit(False)
    for word in P.KEY_LIBRARY_WORDS:
        key_library = key_library | F.lower("path").contains(word)
    overlap = lambda names: F.arrays_overlap("imports", F.array(*map(F.lit, names)))
    credential = (col("sensitive") > 0) & col("exfil")
    bulk = ~credential & (col("sensitive") >= 3)
    indirect = has("getattr_concat") | has("getattr_builtins") | has("dict_builtins") | has("global_computed")
    git = (has("git_py") | has("git_js")) & (col("sensitive") > 0) & has("git_write")
    before = [
        _finding(has("base64"), "obfuscation:base64", "medium"),
        _finding(n("char_list") > 0, "obfuscation:char_list_join", "high", n("char_list")),
        _finding(n("objc") > 0, "obfuscation:objc_string_array", "high", n("objc")),
        _finding(n("cpp") > 0, "obfuscation:cpp_string_concat_chain", "medium", n("cpp")),
        _finding(col("evals") > 0, "obfuscation:eval_exec", "medium", col("evals")),
        *[_finding(n(k) > 0, f"obfuscation:{k}", "medium", n(k)) for k in ("fromcharcode", "atob", "js_obfusc", "packed_js")],
        _finding(n("hex_escape") > 0, "obfuscation:hex_escape", F.when(col("early") > 0, "medium").otherwise("info"), n("hex_escape")),
        _finding(col("invisible") > 50, "obfuscation:invisible_unicode", col("unseen"), col("invisible")),
        _finding(has("decoder"), "obfuscation:unicode_decoder", "high"),
        _finding(col("dynamic_imports"), "obfuscation:dynamic_import", "medium", F.size("dynamic")),
        _finding(has("xor"), "obfuscation:xor_transform", "medium"),
        _finding(has("marshal"), "obfuscation:marshal", "medium"),
        _finding(has("rot13"), "obfuscation:rot13", "medium"),
        _finding(col("dynamic_imports") & (has("exec_compile") | (col("evals") > 0)), "obfuscation:import_exec_chain", "high"),
        _finding(has("nested"), "obfuscation:nested_decode", "high"),
        _finding(col("indicators") >= 3, "obfuscation:combined", "high", col("indicators")),
        _finding(F.size("imports") > 0, "import:suspicious", F.when(overlap(P.EXEC_IMPORTS) & overlap(P.NETWORK_IMPORTS), "medium").otherwise("low"), F.size("imports")),
    ]
    # nth: which of the urls (1 and up) or sockets (-1 and down) it is.
    made = lambda category, severity, nth: F.struct(F.lit("source-heuristic").alias("source"), F.lit(category).alias("category"), severity.alias("severity"), F.lit(1).alias("hits"), nth.alias("nth"))
    url = lambda u, i: (
        F.when(paths.is_metadata_address(u), made("import:cloud_metadata", F.lit("high"), i + 1))
        .when(paths.is_private_address(u), F.when(~col("in_test"), made("import:hardcoded_ip", F.lit("medium"), i + 1)))
        .otherwise(made("import:hardcoded_ip", F.when(col("in_test"), "medium").otherwise("high"), i + 1))
    )
    socket = lambda a, i: F.when(~paths.is_private_address(a) & ~col("in_test"), made("import:hardcoded_ip", F.lit("high"), -i - 1))
    after = [
        _finding(n("btc") > 0, "crypto:btc_addr", "medium", n("btc")),
        _finding(n("eth") > 0, "crypto:eth_addr", "medium", n("eth")),
        _finding(has("embedded_pe"), "payload:embedded_pe", "high"),
        _finding(n("shellcode") > 0, "payload:shellcode", F.when(likely_data, "medium").otherwise("high"), n("shellcode")),
        _finding((col("n_long") > 0) & ~col("in_data"), "payload:long_string", "medium", col("n_long")),
        _finding(has("data_uri"), "payload:data_uri", "medium"),
        _finding(has("private_key"), "secret:private_key", F.when(col("in_test") | key_library, "info").otherwise("high")),
        _finding(n("aws") > 0, "secret:aws_key", "high", n("aws")),
        _finding(n("github") > 0, "secret:github_token", "high", n("github")),
        _finding(n("api_key") > 0, "secret:api_key", "medium", n("api_key")),
        _finding(
            credential,
            F.when(col("in_install"), "behavioral:install_hook_credential_exfil").otherwise("behavioral:credential_access_exfil"),
            F.when(col("in_install"), "high").otherwise("medium"),
            col("sensitive"),
        ),
        _finding(bulk, "behavioral:bulk_credential_access", "medium", col("sensitive")),
        _finding(has("dns"), "behavioral:dns_exfiltration", "high"),
        _finding(git, "behavioral:git_exfiltration", "high"),
        _finding(has("migration") & (col("sensitive") > 0), "behavioral:migration_credential_theft", "high"),
        _finding(has("getattr_concat"), "obfuscation:indirect_exec:getattr_concat", "high"),
        _finding(~has("getattr_concat") & has("getattr_builtins"), "obfuscation:indirect_exec:getattr_builtins", "medium"),
        _finding(has("dict_builtins"), "obfuscation:indirect_exec:dict_builtins", "medium"),
        _finding(has("global_computed"), "obfuscation:indirect_exec:global_computed", "medium"),
        _finding(col("in_install") & (has("curl_pipe") | (has("remote_fetch") & has("install_exec"))), "supply_chain:install_dropper", "high"),
        _finding(credential & ~col("in_install") & indirect, "compound:credential_theft_with_evasion", "high"),
    ]
    every = F.array_compact(F.concat(F.array(*before), F.transform("urls", url), F.transform("sockets", socket), F.array(*after)))
    m = m.withColumn("findings", every)
    m = _with_evidence(m) if evidence else m
    # The outer form: of the plain one the optimizer derives a filter on the size of the array, for which all findings are made once more.
    rows = m.select("path", F.posexplode_outer("findings").alias("place", "o")).filter("o IS NOT NULL")
    return rows.select("path", (F.col("place") + 1).alias("ordinal"), "o.*").drop("nth")
