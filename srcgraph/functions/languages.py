"""The language dimension: one row per adapter, everything a parse needs as data.

``engine`` says how symbols are found: ``regex`` rows are parsed by the JVM
expressions of ``operators/parse.py`` with the patterns held in the row,
``python`` / ``html`` / ``css`` rows by the small helpers of
``functions/trees.py``.  Registering another adapter is adding a row.
"""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, types as T

from srcgraph.functions.fixed import EGG_INFO_SUFFIX

RULE_TYPE = T.StructType([
    T.StructField("pattern", T.StringType()),   # starts with ^, so one hit per line
    T.StructField("label", T.StringType()),     # replacement text giving the name
    T.StructField("kind", T.StringType()),
    T.StructField("calls", T.BooleanType()),    # collect call names of the block
    T.StructField("role", T.StringType()),      # top / dedupe / container / member / loose
    T.StructField("exclude", T.ArrayType(T.StringType())),
])
IMPORT_TYPE = T.StructType([
    T.StructField("pattern", T.StringType()),
    T.StructField("inner", T.StringType()),     # second pattern applied inside each hit
    T.StructField("separator", T.StringType()), # rewritten to '/'
    T.StructField("skip", T.ArrayType(T.StringType())),
    T.StructField("drop", T.StringType()),
])
LANGUAGE_SCHEMA = T.StructType([
    T.StructField("adapter", T.StringType()),
    T.StructField("language", T.StringType()),
    T.StructField("engine", T.StringType()),
    T.StructField("extensions", T.ArrayType(T.StringType())),
    T.StructField("skip_dirs", T.ArrayType(T.StringType())),
    T.StructField("skip_suffix", T.StringType()),
    T.StructField("rules", T.ArrayType(RULE_TYPE)),
    T.StructField("imports", T.ArrayType(IMPORT_TYPE)),
    T.StructField("branch", T.StringType()),
    T.StructField("call", T.StringType()),     # group 1 is the called name
    T.StructField("opener", T.StringType()),
    T.StructField("closer", T.StringType()),
    T.StructField("nest_closer", T.StringType()),
    T.StructField("name_junk", T.StringType()),
    T.StructField("block_mode", T.StringType()),  # brace/after/arrow/inline/statement
])

# Java flags: (?m) ^ at every line, (?d) only \n ends a line, (?U) Unicode \w and \s.
FLAGS = "(?mdU)"


def rule(pattern, label="$1", kind="function", calls=True, role="top", exclude=""):
    return dict(pattern=FLAGS + pattern, label=label, kind=kind, calls=calls,
                role=role, exclude=exclude.split())


def imports(pattern, inner=None, separator=None, skip=(), drop=None):
    return dict(pattern=FLAGS + pattern, inner=inner, separator=separator,
                skip=list(skip), drop=drop)


def words(text: str, flags: str = "(?U)") -> str:
    """Whole-word alternation; '+' inside a word stands for whitespace.

    The first letters are looked at before anything else, since most places have another one.
    """
    first = "".join(sorted({w[0] for w in text.split()}))
    return flags + rf"(?=[{first}])\b(?:" + "|".join(w.replace("+", r"\s+") for w in text.split()) + r")\b"


@dataclass(frozen=True)
class Language:
    adapter: str
    language: str
    extensions: list[str]
    engine: str = "regex"
    skip_dirs: str = ""
    skip_suffix: str | None = None
    rules: list[dict] = field(default_factory=list)
    imports: list[dict] = field(default_factory=list)
    branch: str = words("if")
    name_chars: str = r"\w"       # characters of a called name
    call_exclude: str = ""        # names that only look called
    call_flags: str = ""
    opener: str = r"\{"
    closer: str = r"\}"
    nest_closer: str = r"\}"
    name_junk: str = ""
    block_mode: str = "brace"
    mark: Mark | None = None

    @property
    def call(self) -> str:
        # a name that no parenthesis follows is not compared with the excluded ones
        excluded, followed = "|".join(self.call_exclude.split()), rf"(?=[{self.name_chars}]++\s*+\()"
        guard = f"{followed}(?!(?{self.call_flags}:{excluded})(?![{self.name_chars}]))" if excluded else ""
        if "." in self.name_chars:  # one attempt per run of name characters
            return rf"(?U)(?<![{self.name_chars}])\.*+{guard}([{self.name_chars}]++)(?=\s*+\()"
        return rf"(?U)\b{guard}([{self.name_chars}]++)(?=\s*+\()"

    def row(self) -> tuple:
        values = {**self.__dict__, "skip_dirs": self.skip_dirs.split(), "call": self.call}
        return tuple(values[f.name] for f in LANGUAGE_SCHEMA.fields)


# --- linear patterns ---------------------------------------------------------
# Every declaration pattern is tried once per line start and must not read the
# same text again from the next one.  What a pattern may read far ahead of its
# line is therefore either consumed even where it leads to no declaration (a run
# of type tokens or modifiers, parameters up to their closing parenthesis: no
# declaration inside them could end differently), or marked beforehand (``Mark``).
# Hits without a name are no declarations.
GOOD = "\u0007"  # a mark of ``Mark``; texts do not hold it


@dataclass(frozen=True)
class Mark:
    """Put GOOD after every ``opener`` whose next ``closer`` is followed by ``follow``, and after that closer."""
    closer: str
    follow: str
    opener: str


def tokens(chars: str) -> str:
    """A type token and the blanks after it, not the name before a parenthesis."""
    return rf"(?:[{chars}]++\s++(?!\())"


def modifiers(before: str, kinds: str, after: str, both: str | None = None) -> str:
    """A run of modifiers from a line start, then a declaration of one of the kinds.

    ``both`` is a word that is a modifier and a kind: if no kind follows the run,
    the last one that a word follows names the declaration, in group 2.
    """
    words_before = f"{before}|{both}" if both else before
    run = rf"(?:(?:{words_before})\s++)"
    last = rf"|(?:(?:(?:{before})\s++)*+{both}\s++(?=\w))++{after}" if both else ""
    return rf"^[ \t]*+(?=(?:{words_before}|{kinds})\s)(?:{run}*+(?:{kinds})\s++{after}{last}|{run}++)"


def called_with(name: str, suffix: str, skip: str = "") -> str:
    """``name(parameters) suffix``, else what may be left out: the name and its parameters."""
    bare = name.replace("(", "(?:") if name.startswith("(") else name
    return rf"(?:{name}\s*+\([^)]*+\){suffix}|{bare}\s*+\([^)]*+{skip})?+"


# --- fixed values: vocabularies and text patterns per language ---------------
ARROW_TAIL = r"\s*+(?::\s*+(?:(?!=>)(?:[^\s()]|\([^\s()]*+\)))++\s*+)?+=>"
C_QUALIFIERS = r"(?:\s*+(?:const|noexcept|override|final))*+\s*+"
C_BODY = C_QUALIFIERS + r"(?::[^{]*+)?+\{"
C_SKIP = r"(?:\)" + C_QUALIFIERS + r":[^{]*+\z)?+"  # no brace follows to the end of the text
RUST_VISIBLE = rf"^[ \t]*+(?:pub(?:\({GOOD}[^)]++\){GOOD})?+\s++)?+"
C_BASES = r"\s*+(?::[\w:,\s]*+)?+"
BUILTIN_LANGUAGES = [
    Language("python", "Python", ["py"], "python",
             "__pycache__ venv env node_modules dist build", EGG_INFO_SUFFIX),
    Language(
        "javascript", "JavaScript/TypeScript", "js ts jsx tsx mjs cjs".split(),
        skip_dirs="node_modules dist build coverage __pycache__ venv",
        skip_suffix=EGG_INFO_SUFFIX,
        rules=[
            rule(r"^[ \t]*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s+(\w+)\s*[(<]"),
            # an arrow on the line of the name, or after parameters that a line ending in ( or , begins
            rule(r"^[ \t]*(?:export\s+)?(?:const|let|var)\s+(\w++)\s*+[:=][^=]"
                 r"(?:.*?=>|.*(?<=[(,])" + GOOD + r"\n[^)]*+\)" + GOOD + ARROW_TAIL + ")", role="dedupe"),
            rule(r"^[ \t]*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)",
                 kind="class", calls=False, role="container"),
            rule(r"^[ \t]++(?:(?:public|private|protected|static|async|override|readonly)\s++(?!\())*+"
                 + called_with(r"(\w++)", r"\s*+(?::\s*+\S[^\s{]*+\s*+)?+\{"), kind="method", role="member",
                 exclude="constructor super return if for while"),
        ],
        imports=[
            # a clause up to its string or semicolon, then what it names
            imports(r"""(?=i)(\bimport\s++[^'";]*+(?:['"][^'"]++['"])?+)""", drop="^node:",
                    inner=r"""(?:\Aimport\s++[^'";]*?\sfrom\s++|\bimport\s++)['"]([^'"]+)['"]"""),
            imports(r"""(?=[ri])(?:\brequire|\bimport)\s*\(\s*['"]([^'"]+)['"]\s*\)""", drop="^node:"),
            imports(r"""(?=e)(\bexport\s[^'"]*+(?:['"][^'"]++['"])?+)""", drop="^node:",
                    inner=r"""\Aexport\s[^'"]*?\sfrom\s++['"]([^'"]+)['"]"""),
        ],
        branch=words("if else+if for while switch catch finally case"),
        call_exclude="if for while switch catch function class return typeof instanceof "
                     "new delete void throw",
        block_mode="after", mark=Mark(")", ARROW_TAIL, r"(?<=[(,])(?=\n)")),
    Language(
        "c", "C/C++", "c cpp cc cxx h hpp hh hxx".split(),
        skip_dirs="build dist cmake-build-debug cmake-build-release __pycache__ "
                  "node_modules out obj CMakeFiles Debug Release",
        rules=[
            # blank lines before the first token belong to the declaration
            rule(r"^(?![ \t]*#)(?:\s*+" + tokens(r"\w:*&<>") + "++(?:(?:[\\w:~]+::)?"
                 + called_with(r"(\w++)", C_BODY, C_SKIP) + r")?+|\s++)",
                 exclude="if for while switch return else catch"),
            rule(rf"^[ \t]*+(?:template\s*+<{GOOD}[^>]*+>{GOOD}\s*+)?+(?:class|struct)\s++"
                 rf"(?:(\w++){C_BASES}\{{|\w++\s*+:[\w:,\s]*+)", kind="class", calls=False, role="container"),
            rule(r"^[ \t]++" + tokens(r"\w:*&<>~") + "*+" + called_with(r"(~?\w++)", C_BODY, C_SKIP),
                 kind="method", role="member", exclude="if for while return"),
        ],
        imports=[imports(r'^[^\S\n]*+#\s*include\s+"([^"]+)"')],
        branch=words("if else+if for while switch case catch goto"),
        call_exclude="if for while switch return sizeof typeof case catch class struct new "
                     "delete throw void int char float double long short unsigned signed "
                     "static inline extern",
        mark=Mark(">", rf"\s*+(?:class|struct)\s++\w++{C_BASES}\{{", "<")),
    Language(
        "java", "Java", ["java"], skip_dirs="build dist target out",
        rules=[
            rule(modifiers("public|protected|private|abstract|static|final|strictfp",
                           "class|interface|enum|record", r"(\w++)"), kind="class", calls=False, role="container"),
            rule(r"^[ \t]++" + tokens(r"\w<>,\[\]?") + "++"
                 + called_with(r"(\w++)", r"(?:\s*+throws\s[\w,\s]++)?+\s*+\{"), kind="method", role="member",
                 exclude="if for while switch return catch try synchronized class interface "
                         "new throw void super this case"),
        ],
        imports=[imports(r"^[^\S\n]*+import\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;")],
        branch=words("if else+if for while switch case catch finally try"),
        call_exclude="if for while switch return catch try synchronized class interface new "
                     "throw void super this case"),
    Language(
        "csharp", "C#", ["cs"], skip_dirs="bin obj Properties packages",
        rules=[
            rule(modifiers("public|protected|internal|private|abstract|sealed|static|partial",
                           "class|struct|interface|record", r"(\w++)"), kind="class", calls=False, role="container"),
            rule(r"^[ \t]++" + tokens(r"\w<>,\[\]?") + "++"
                 + called_with(r"(\w++)", r"(?:\s*+where\s++[^\n{]*+)?+\s*+\{"), kind="method", role="member",
                 exclude="if for foreach while switch return catch try class interface new throw "
                         "void base this case typeof nameof sizeof"),
        ],
        imports=[imports(r"^[^\S\n]*+using\s+(?:static\s+)?([\w.]+)\s*;")],
        branch=words("if else+if for foreach while switch case catch finally try"),
        call_exclude="if for foreach while switch return catch try class interface new throw "
                     "void base this case typeof nameof sizeof"),
    Language(
        "go", "Go", ["go"], skip_dirs="vendor bin pkg",
        rules=[
            rule(r"^[ \t]*type\s+(\w+)\s+(?:struct|interface)\s*\{", kind="class", calls=False),
            rule(rf"^[ \t]*+func\s++(?:\({GOOD}[^)]++\){GOOD}\s++)?+(\w++)\s*+\(", role="bodied",
                 exclude="if for switch select return defer go type func struct interface case "
                         "make new panic recover append len cap"),
        ],
        imports=[imports(r'^[^\S\n]*+import\s+"([^"]+)"'),
                 imports(r"^[^\S\n]*+import\s*+\((?:([^)]*+)\)|[^)]*+\z)", inner='"([^"]+)"')],
        branch=words("if else+if for switch case select defer"),
        call_exclude="if for switch select return defer go type func struct interface case make "
                     "new panic recover append len cap",
        mark=Mark(")", r"\s++\w++\s*+\(", r"\((?=[^)])")),
    Language(
        "rust", "Rust", ["rs"], skip_dirs="target vendor",
        rules=[
            rule(RUST_VISIBLE + r"(?:struct|enum|trait)\s++(\w++)", kind="class", calls=False),
            rule(RUST_VISIBLE + r"(?:async\s++)?+(?:const\s++)?+fn\s++(\w++)\s*+\(",
                 exclude="if for while loop match return let mut pub fn struct enum trait impl "
                         "use crate mod super self Self where async await break continue"),
        ],
        imports=[imports(r"^[^\S\n]*+(?:pub\s+)?use\s+([\w:]+)", separator="::",
                         skip=["", "crate", "self", "super"], drop="^(?:std|core|alloc)(?:/|$)"),
                 imports(r"^[^\S\n]*+(?:pub\s+)?mod\s+(\w+)\s*;")],
        branch=words("if else+if for while loop match"),
        call_exclude="if for while loop match return let mut pub fn struct enum trait impl use "
                     "crate mod super self Self where async await break continue",
        mark=Mark(")", r"\s++(?:(?:async\s++)?+(?:const\s++)?+fn\s++\w++\s*+\(|(?:struct|enum|trait)\s++\w)",
                  r"\((?=[^)])")),
    Language(
        "dart", "Dart", ["dart"], skip_dirs="build ios android web linux macos windows",
        rules=[
            rule(modifiers("abstract|sealed|final|base|interface", "class|extension", r"(\w++)", "mixin"), "$1$2",
                 kind="class", calls=False, role="container"),
            rule(r"^[ \t]*+" + tokens(r"\w<>,_\[\]?") + "++"
                 + called_with(r"(_?\w++)", r"(?:\s*+async\*?+|\s*+sync\*)?+\s*+[{=]"), kind="method", role="member",
                 exclude="if for while switch return catch try class mixin extension new throw "
                         "void super this case await yield var final const late get set"),
        ],
        imports=[imports(r"""(?=[ipe])\b(?:import|part|export)\s+['"]([^'"]+)['"]""",
                         drop="^(?:package|dart):")],
        branch=words("if else+if for while switch case catch finally try"),
        call_exclude="if for while switch return catch try class mixin extension new throw void "
                     "super this case await yield var final const late get set",
        block_mode="arrow"),
    Language(
        "php", "PHP", ["php"], skip_dirs="vendor node_modules storage",
        rules=[
            rule(modifiers("abstract|final|readonly", "class|interface|trait|enum", r"(\w++)"), kind="class",
                 calls=False, role="container"),
            rule(modifiers("public|protected|private|static|final|abstract", "function", r"(&?\w++)\s*+\("),
                 kind="method", role="loose",
                 exclude="if elseif for foreach while switch return catch try class interface "
                         "trait new throw case echo print require require_once include "
                         "include_once isset empty unset die exit array list function"),
        ],
        imports=[imports(r"^[^\S\n]*+use\s+([\w\\]+)\s*(?:;|\s+as)", separator="\\"),
                 imports(r"""(?=[ri])\b(?:require|require_once|include|include_once)\s*\(?\s*"""
                         r"""['"]([^'"]+)['"]""")],
        branch=words("if elseif for foreach while switch case catch try"),
        call_exclude="if elseif for foreach while switch return catch try class interface trait "
                     "new throw case echo print require require_once include include_once isset "
                     "empty unset die exit array list function",
        name_junk="^&"),
    Language(
        "r", "R", ["r"], skip_dirs="renv packrat data inst",
        rules=[rule(r"^[ \t]*(`?[\w.]+`?)\s*(?:<-|=)\s*function\s*\(",
                    exclude="if else for while repeat break next function return switch library "
                            "require in TRUE FALSE NULL NA NaN Inf")],
        imports=[imports(r"""(?=s)\bsource\s*\(\s*['"]([^'"]+)['"]""")],
        branch=words("if else for while repeat switch"),
        name_chars=r"\w.",
        call_exclude="if else for while repeat break next function return switch library require "
                     "in TRUE FALSE NULL NA NaN Inf",
        name_junk="`", block_mode="inline"),
    Language(
        "sql", "SQL", ["sql"],
        rules=[rule(r"(?i)^[ \t]*CREATE\s+(?:OR\s+REPLACE\s+)?"
                    r"(TABLE|PROCEDURE|FUNCTION|VIEW|TRIGGER)\s+([`\"\[\]\w.]+)",
                    label="$2 ($1)", kind="ddl")],
        branch=words("IF ELSEIF ELSIF CASE WHEN WHILE LOOP FOR", "(?iU)"),
        call_exclude="IF ELSE CASE WHEN THEN END SELECT INSERT UPDATE DELETE FROM WHERE AND OR "
                     "IN NOT IS NULL AS CREATE ALTER DROP TABLE VIEW FUNCTION PROCEDURE TRIGGER "
                     "INDEX PRIMARY FOREIGN KEY JOIN INNER OUTER LEFT RIGHT ON GROUP BY ORDER "
                     "HAVING LIMIT MAX MIN SUM AVG COUNT COALESCE CAST CONVERT",
        call_flags="i",
        opener=words("BEGIN", "(?iU)"), closer=words("END", "(?iU)"), nest_closer=words("END COMMIT", "(?iU)"),
        name_junk=r'[`"\[\]]', block_mode="statement"),
    Language("html", "HTML", ["html", "htm"], "html",
             "node_modules dist build coverage venv"),
    Language("css", "CSS", ["css"], "css", "node_modules dist build coverage venv",
             imports=[imports(r"""@import\s+(?:url\s*\(\s*)?['"]([^'"]+)['"]""")]),
]


class AdapterRegistry:
    """Adapter name -> language row.  Later registrations win an extension."""

    def __init__(self, languages=BUILTIN_LANGUAGES):
        self._languages = {language.adapter: language for language in languages}
        self.parsers: dict[str, Callable[[str], dict]] = {}

    def register(self, language: Language) -> "AdapterRegistry":
        taken = {e.lower().lstrip(".") for e in language.extensions}
        self._languages = {
            name: replace(other, extensions=[e for e in other.extensions if e not in taken])
            for name, other in self._languages.items()
        }
        self._languages[language.adapter.lower()] = replace(
            language, adapter=language.adapter.lower(), extensions=sorted(taken))
        return self

    def register_parser(self, adapter: str, extensions: list[str], parser: Callable[[str], dict],
                        language: str | None = None, skip_dirs: str = "") -> "AdapterRegistry":
        """Adapter whose files a function of the user parses: text -> dict(symbols=[..], imports=[..]).

        Symbols have the fields of ``functions.trees.symbol``.  The function runs
        in the tasks, once per file; if it fails, that file has no symbols.
        """
        engine = f"own:{adapter.lower()}"
        self.parsers[engine] = parser
        return self.register(Language(adapter, language or adapter.capitalize(), list(extensions), engine, skip_dirs))

    def get(self, name: str) -> Language:
        if name.lower() not in self._languages:
            raise ValueError(f"no adapter for language {name!r}; "
                             f"available: {', '.join(self._languages)}")
        return self._languages[name.lower()]

    def names(self) -> list[str]:
        return sorted(self._languages)

    def languages(self) -> list[Language]:
        return list(self._languages.values())

    def frame(self, spark: SparkSession) -> DataFrame:
        """The dimension as a table; its size is the number of adapters."""
        return spark.createDataFrame([l.row() for l in self._languages.values()], LANGUAGE_SCHEMA)

    def list_adapters(self) -> dict[str, list[str]]:
        return {l.adapter: ["." + e for e in l.extensions] for l in self._languages.values()}
