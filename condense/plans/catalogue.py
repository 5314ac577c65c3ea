"""The built-in rules: which output they take, and the chain of stages each runs.

Rules are plain data.  ``condense.sources.rules`` reads more of them from TOML files.  The order is
the order of lookup; ``generic`` takes what no other rule does and stays last.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from condense.operators import outlines as _outlines  # noqa: F401  registers its stages
from condense.operators.stages import STAGES, Stage
from condense.plans.cases import CASES
from condense.plans.pipeline import Pipeline


@dataclass(frozen=True)
class Rule:
    name: str
    match_command: tuple[str, ...] = ()
    match_content_types: tuple[str, ...] = ()
    stages: tuple[Stage, ...] = ()
    abort_unless: tuple[str, ...] = ()
    abort_if: tuple[str, ...] = ()
    on_empty: str | None = None
    tier: str = "builtin"
    tests: tuple[dict, ...] = ()

    def pipeline(self) -> Pipeline:
        return Pipeline(list(self.stages), self.abort_unless, self.abort_if, self.on_empty)


def stage(kind: str, **settings) -> Stage:
    return STAGES[kind](**{k: tuple(v) if isinstance(v, list) else v for k, v in settings.items()})


def strip(*patterns: str, keep: tuple[str, ...] = ()) -> Stage:
    return stage("strip_lines", patterns=patterns, preserve_patterns=keep)


def group(*patterns: str, **settings) -> Stage:
    return stage("group_repeated", patterns=patterns, **settings)


def budget(limit: int, strategy: str = "tail", keep: tuple[str, ...] = ()) -> Stage:
    return stage("max_tokens", limit=limit, strategy=strategy, preserve_patterns=keep)


def padding(*patterns: str, max_gaps: int | None = None) -> Stage:
    return stage("column_padding_compression", patterns=patterns, max_gaps=max_gaps)


def code(language: str) -> Stage:
    return stage("python_ast_summarize") if language == "python" else stage("code_ast_summarize", language=language)


def data(kind: str) -> Stage:
    return stage("structured_data_summarize", format=kind)


ansi, dedup = stage("remove_ansi"), stage("deduplicate_consecutive")
BLANK = r"^\s*$"
TROUBLE = (r"(?i)\berror\b", r"(?i)\bwarn(ing)?\b", r"(?i)\bfail(ed|ure|ures)?\b", r"(?i)\bexception\b", r"(?i)\bfatal\b", r"(?i)\bpanic\b")
SECURITY = (r"(?i)\b(todo|fixme|hack|xxx)\b", r"(?i)\b(security|unsafe|deprecated)\b")
CODE_KEEP = (*SECURITY, r"^\s*(import|from|use|using|package|namespace)\b", r"^\s*(pub |public |export |def |class |func |fn |interface |struct |enum |trait )", r"^#!")
KEYED = (r"(?i)(key|token|secret|password|url|host|port)", r"^\s*\[", r"=\s*\S", r":\s*\S", r"(?i)\b(version|name)\b", r"\$\{")


def read(*suffixes: str) -> tuple[str, ...]:
    return (rf"^(cat|head|tail|less|more|bat)\b.*\.({'|'.join(suffixes)})(\s|$)",)


def source_rule(name: str, language: str, *suffixes: str, comments: tuple[str, ...] = (r"^\s*//\s*[-=*#]{3,}",)) -> Rule:
    return Rule(name, read(*suffixes), stages=(code(language), strip(BLANK, *comments, keep=CODE_KEEP), dedup, budget(800, "both")), on_empty="(only blank lines)")


def data_rule(name: str, kind: str, types: tuple[str, ...], *suffixes: str, strips: tuple[str, ...] = ()) -> Rule:
    more = (strip(*strips, keep=KEYED),) if strips else ()
    return Rule(name, read(*suffixes), types, (data(kind), *more, budget(2000, "both")), on_empty="(no data)")


def package_manager(name: str, command: str, *noise: str, keep: tuple[str, ...] = (), timed: bool = False) -> Rule:
    chain = [ansi, group(r"^(npm |pnpm |yarn )?(warn|warning)\b", min_count=2), strip(BLANK, *noise, keep=(*TROUBLE, r"(?i)\b(added|removed|changed|audited|done|success)\b", r"(?i)vulnerabilit", *keep)), dedup]
    return Rule(name, (command,), stages=tuple(chain + [stage("relative_timestamp_compression")] * timed))


RULES: tuple[Rule, ...] = (
    Rule("mypy", (r"^(python3? -m )?mypy\b",), ("mypy",), (group(r": error: ", location_pattern=r"^(.*?): error: ", min_count=3, scope="global"), strip(BLANK, r": note: See https?://", r"^\s*\^+\s*$", keep=(r": error: ", r"^Found \d+ error", r"^Success:", r": note: Revealed")), budget(400)), abort_unless=("error", "Success", "note:"), on_empty="mypy: nothing to report"),
    Rule("ruff", (r"^(python3? -m )?ruff\b",), stages=(strip(BLANK, r"^\s*\|\s*$", r"^\s*= help:", keep=(r"^\S+:\d+:\d+:", r"^Found \d+ error", r"^All checks passed")), budget(300)), abort_unless=(":", "passed", "Found"), on_empty="ruff: nothing to report"),
    source_rule("cat-csharp", "csharp", "cs"),
    Rule("dotenv", (r"^(cat|head|tail)\b.*\.env(\.\w+)?(\s|$)",), stages=(strip(BLANK, r"^\s*#\s*[-=]{3,}", keep=KEYED),), on_empty="(no settings)"),
    Rule("cat-go", read("go"), stages=(code("go"), dedup, budget(800, "both")), on_empty="(only blank lines)"),
    Rule("ini", read("ini", "cfg", "conf"), stages=(strip(BLANK, r"^\s*[;#]\s*[-=]{3,}", keep=KEYED),), on_empty="(no settings)"),
    source_rule("cat-java", "java", "java"),
    source_rule("cat-javascript", "javascript", "js", "jsx", "mjs", "cjs"),
    data_rule("cat-json", "json", ("json",), "json"),
    source_rule("cat-python", "python", "py", "pyi", comments=(r"^\s*#\s*[-=*#]{3,}",)),
    source_rule("cat-rust", "rust", "rs"),
    data_rule("cat-toml", "toml", ("toml",), "toml", strips=(BLANK,)),
    source_rule("cat-typescript", "typescript", "ts", "mts", "cts"),
    Rule("cat-tsx", read("tsx"), stages=(code("tsx"), dedup, budget(800, "both")), on_empty="(only blank lines)"),
    data_rule("cat-yaml", "yaml", (), "ya?ml", strips=(BLANK,)),
    Rule("markdown", read("md", "markdown", "rst"), stages=(strip(r"^$", keep=(r"^#{1,6} ", r"^\s*[-*+] ", r"^\s*\d+\. ", r"^```", r"^\|", r"^> ", r"https?://", r"(?i)\bwarning\b")), dedup, budget(2000, "head")), on_empty="(empty document)"),
    Rule("document-text", read("pdf", "docx", "txt"), stages=(strip(r"^$", keep=(r"^#{1,6} ", r"^\s*[-*+] ", r"^\s*\d+\. ", r"^\|", r"^> ", r"https?://", r"(?i)\bwarning\b")), dedup, budget(2000, "head")), on_empty="(empty document)"),
    Rule("cat", (r"^(cat|head|tail|less|more|bat)\b",), stages=(strip(BLANK, r"^\s*#\s*[-=*#]{3,}", r"^\s*//\s*[-=*#]{3,}", r"^\s*[-=*]{10,}\s*$", keep=(*TROUBLE, r"^#!")), dedup, budget(800, "both"))),
    Rule("docker-build", (r"^docker( buildx| compose)? build\b",), stages=(ansi, strip(BLANK, r"^#\d+ (sha256|transferring|extracting|resolve)", r"^ ---> [0-9a-f]{12}$", r"^#\d+ DONE 0\.\ds$", keep=(*TROUBLE, r"^Step \d+", r"(?i)successfully")), dedup, budget(600))),
    Rule("gradle", (r"^(\./)?gradlew?\b",), stages=(ansi, group(r"^Download(ing)? https?://", min_count=3, preserve_patterns=TROUBLE[:4]), group(r"^> Task .*(UP-TO-DATE|NO-SOURCE|FROM-CACHE)$", min_count=2), stage("path_prefix_fold", patterns=(r"^> Task :\S+$",), separator=":"), strip(BLANK, r"^Starting a Gradle Daemon", r"^To honour the JVM", r"^Daemon will be stopped", r"^Deprecated Gradle features", keep=(*TROUBLE, r"^BUILD ")), budget(500))),
    Rule("maven", (r"^(\./)?mvnw?\b",), stages=(ansi, group(r"^(\[INFO\] )?Download(ing|ed)( from [^:]+)?: ", min_count=3, preserve_patterns=TROUBLE[:5]), strip(BLANK, r"^\[INFO\]\s*$", r"^\[INFO\] -+$", r"^\[INFO\] --- ", keep=(*TROUBLE, r"BUILD (SUCCESS|FAILURE)", r"Tests run:")), budget(500))),
    Rule("github-actions", (r"^(gh run view|act)\b",), stages=(ansi, stage("regex_replace", rules=((r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d+Z ", ""),)), group(r"^##\[debug\]", min_count=2), strip(BLANK, r"^##\[(end)?group\]", keep=(*TROUBLE[:4], r"^##\[(error|warning)\]")), budget(800))),
    Rule("docker-ps", (r"^docker( container)? (ps|ls)\b",), stages=(ansi, padding(r"\S {2,}\S"), budget(800))),
    Rule("docker-images", (r"^docker (images|image ls)\b",), stages=(ansi, padding(r"\S {2,}\S"), budget(800))),
    Rule("gcc", (r"^(gcc|g\+\+|cc|c\+\+|clang(\+\+)?|make|cmake|ninja)\b",), stages=(ansi, group(r"^\[\s*\d+%\]", r"^(CC|CXX|LD|AR)\s", r"^\s*(gcc|g\+\+|clang)\s.*-c\s", r"^-- (Looking|Performing|Detecting|Check)", min_count=3, preserve_patterns=(r"(?i)\berror\b",)), group(r": warning: ", r": error: ", location_pattern=r"^(.*?): (?:warning|error): ", min_count=3, scope="global"), strip(BLANK, r"^make(\[\d+\])?: (Entering|Leaving) directory", r"^\s*\|\s*~*\^", r"^\s+from .*[,:]$", r"^In file included from", r"^-- (Configuring|Generating|Build files)", keep=(*TROUBLE, r"undefined reference")), dedup, budget(500, keep=(r": error: ", r"undefined reference", r"(?i)fatal error", r"\*\*\* \[", r"^collect2:"))), abort_unless=(":", "%", "make", "--"), on_empty="build: nothing to report"),
    Rule("git-status", (r"^git status\b",), stages=(strip(BLANK, r"^\s*\(use \"git ", r"^On branch ", r"^Your branch is up to date", r"^no changes added to commit", r"^nothing to commit", r"^\s*\(commit or discard", keep=(r"^\s*(modified|new file|deleted|renamed|both modified):", r"^(?=\S| \S)[ MADRCU?!]{1,2} \S", r"^(Changes|Untracked|Unmerged)", r"(?i)conflict", r"(ahead|behind|diverged)", r"(?i)rebase|merge|cherry", r"HEAD detached")), dedup)),
    Rule("git-log", (r"^git log\b",), stages=(strip(BLANK, r"^Author:\s", r"^Merge:\s", keep=(r"^commit [0-9a-f]{7,40}", r"^[0-9a-f]{7,40} ", r"^Date:\s", r"(?i)\b(fix|breaking|revert|security)\b")), budget(400, "head"))),
    Rule("git-diff", (r"^git (diff|show)\b",), ("diff",), (stage("protect_diff_filename_headers"), strip(r"^index [0-9a-f]+\.\.[0-9a-f]+", r"^diff --git ", r"^similarity index", keep=(r"^\+\+\+ b/", r"^--- a/", r"^@@ ", r"^[+-]", r"^rename (from|to) ", r"^Binary files ")), stage("collapse_unchanged_context", context_lines=1), dedup, budget(600, "both"))),
    Rule("git-branch", (r"^git branch\b",), stages=(padding(r"^[* ] \S+ {2,}", max_gaps=1),)),
    Rule("java", (r"^(java|javac|kotlinc?)\b",), stages=(ansi, group(r"^\s+at [\w.$]+\(", min_count=3, preserve_patterns=(r"^Caused by:", r"^Exception in thread", r"(?i)\berror\b", r"^\s*Suppressed:", r"OutOfMemory")), strip(r"^\s*\.\.\. \d+ more$"), dedup, budget(600)), abort_unless=("Exception", "Error", "at ", "error"), on_empty="java: nothing to report"),
    Rule("kubectl-get", (r"^kubectl get\b",), stages=(ansi, padding(r"\S {2,}\S"), budget(800))),
    Rule("eslint", (r"^(npx )?eslint\b",), stages=(ansi, group(r"^\s+\d+:\d+\s+(warning|error)", exact_match=True), strip(BLANK, keep=(r"\berror\b", r"\bwarning\b", r"problems?\b", r"^/", r"^\S+\.\w+$")), budget(400)), abort_unless=("error", "warning", "problem"), on_empty="eslint: nothing to report"),
    Rule("tsc", (r"^(npx )?tsc\b",), stages=(ansi, group(r": error TS\d+:", location_pattern=r"^(.*?): error TS\d+:", scope="global"), strip(BLANK, r"^\s*~+\s*$", keep=(r"error TS\d+",)), budget(400)), abort_unless=("TS", "error"), on_empty="tsc: nothing to report"),
    Rule("jest", (r"^(npx )?jest\b",), stages=(ansi, strip(BLANK, r"^\s*✓ ", r"^PASS ", keep=(r"^FAIL ", r"●", r"^Tests?:", r"^Test Suites:", r"(?i)\berror\b", r"Expected", r"Received", r"^Snapshots:")), dedup, budget(500)), abort_unless=("Test", "PASS", "FAIL"), on_empty="jest: nothing to report"),
    Rule("vitest", (r"^(npx )?vitest\b",), stages=(ansi, strip(BLANK, r"^\s*✓ ", keep=(r"(?i)\bfail", r"×", r"Tests\s", r"Test Files\s", r"(?i)\berror\b", r"Expected", r"Received", r"Duration")), dedup, budget(500)), abort_unless=("Test", "✓", "FAIL"), on_empty="vitest: nothing to report"),
    Rule("prettier", (r"^(npx )?prettier\b",), stages=(ansi, strip(r"\d+ms( \(unchanged\))?$", keep=(r"\[(warn|error)\]", r"(?i)\berror\b", r"Code style")), dedup, budget(400)), abort_unless=("ms", "[warn]", "[error]", "Code style"), on_empty="prettier: nothing to report"),
    package_manager("npm", r"^npm\b", r"^npm (http|timing|sill|verb)\b", r"^\s*run `npm fund`", r"packages are looking for funding", r"^> ", r"(?i)deprecated", timed=True, keep=(r"^npm ERR!", r"peer dep", r"ERESOLVE")),
    Rule("npx", (r"^npx\b",), stages=(ansi, group(r"^npm warn", min_count=2), strip(BLANK, r"^Need to install", r"^Ok to proceed", keep=TROUBLE[:4]), dedup)),
    package_manager("pnpm", r"^pnpm\b", r"^Progress: ", r"^\s*Packages are ", keep=(r"ERR_PNPM", r"^\+ ", r"^- ")),
    package_manager("yarn", r"^yarn\b", r"^(\[\d/\d\]|info|➤ YN0000: [┌└])", r"^\$ "),
    package_manager("bun", r"^bun\b", r"^bun (install|add|run) v", keep=(r"installed", r"^\+ ")),
    Rule("next", (r"^(npx )?next\b",), stages=(ansi, strip(BLANK, r"^\s*(▲|-) Next\.js", r"^\s*- Local:", r"^info  ?- ", r"^\s*Collecting ", r"^\s*Generating static pages", r"Telemetry", keep=(*TROUBLE[:4], r"^Route", r"^[├└┌]")), dedup, budget(500))),
    Rule("turbo", (r"^(npx )?turbo\b",), stages=(ansi, strip(r"cache hit, (replaying|suppressing) (logs|output)", keep=(*TROUBLE[:4], r"^\s*Tasks:", r"^\s*Failed:")), dedup)),
    Rule("pip", (r"^(python3? -m )?pip3?\b",), stages=(ansi, strip(BLANK, r"^\s*Downloading ", r"^\s*Using cached ", r"^\s*[━╸ ]+ ", r"^Requirement already satisfied", r"^\s*Preparing metadata", keep=(*TROUBLE[:3], r"^Successfully", r"(?i)conflict")), padding(r"^\S+ {2,}\S+"), dedup, budget(400))),
    Rule("poetry", (r"^poetry\b",), stages=(ansi, strip(BLANK, r"^\s*[-•] (Downloading|Installing) .*(\d+%|Pending)", r"^Resolving dependencies", keep=(*TROUBLE[:2], r"(?i)\bfail")), padding(r"^\S+ {2,}\S+", max_gaps=2), dedup, budget(400))),
    Rule("pytest", (r"^(python3? -m )?pytest\b",), ("pytest",), (group(r"^FAILED |^E   ", location_pattern=r"^FAILED (\S+)", min_count=2, scope="global"), strip(BLANK, r"^platform ", r"^rootdir:", r"^plugins:", r"^cachedir:", r"^collecting ", r"^configfile:", r" PASSED\s", r"^\S+\.py [.sx]+\s+\[", r"^-+ Captured", r"^=+ test session starts", r"^\s*$", r"^asyncio:", r"^hypothesis profile", keep=(r"^FAILED ", r"^ERROR ", r"^E  ", r"^>  ", r"^=+ .*(failed|passed|error)", r"Error\b", r"^_+ .* _+$")), dedup, budget(500)), abort_unless=("passed", "failed", "error", "collected", "FAILED"), on_empty="pytest: nothing to report"),
    Rule("ps", (r"^ps\b",), stages=(ansi, padding(r"\S {2,}\S", max_gaps=10), budget(800))),
    Rule("df", (r"^(df|du)\b",), stages=(ansi, padding(r"\S {2,}\S", max_gaps=5), budget(400))),
    Rule("ls-long", (r"^ls\s+(-\w*l|--format=long)",), stages=(ansi, padding(r"^[-dlbcps][-rwxsStT]{9}", max_gaps=8), budget(800))),
    Rule("generic", (r".",), stages=(stage("remove_ansi", strip_inline=True), strip(BLANK, keep=TROUBLE[:3]), stage("deduplicate_consecutive", show_count=True), stage("relative_timestamp_compression"), stage("path_prefix_fold", patterns=(r"^\S+/\S*$",)), stage("numeric_range_compression"), budget(1000))),
)

RULES = tuple(replace(r, tests=tuple(CASES[r.name])) for r in RULES)
BY_NAME = {r.name: r for r in RULES}
