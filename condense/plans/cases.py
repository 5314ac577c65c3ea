"""Cases of the built-in rules: an input, lines its result must and mustn't hold, and a least share of characters saved."""

from __future__ import annotations


def case(text: str, has: tuple[str, ...] = (), lacks: tuple[str, ...] = (), saves: float | None = None) -> dict:
    out = {"input": text, "must_contain": has, "must_not_contain": lacks}
    return out if saves is None else out | {"compression_target": saves}


def many(line: str, n: int) -> str:
    """n lines, {} numbered."""
    return "\n".join(line.format(i) for i in range(n))


_JS = "export function f(a) {\n  const b = a + 1;\n  const c = b * 2;\n  return c;\n}\n"
_PROSE = "# Title\n\n\nSome text.\n\n- item one\n- item two\n\n> quoted\n"
_TABLE = "NAME          STATUS      AGE\nalpha         Running     3d\nbeta          Error       1h"

CASES: dict[str, list[dict]] = {
    "mypy": [
        case('a.py:1: error: Bad type  [x]\nb.py:2: error: Bad type  [x]\nc.py:9: error: Bad type  [x]\nd.py:3: note: See https://mypy.example\nFound 3 errors in 3 files', ("a.py:1: error: Bad type", "2 more with the same message at: b.py:2, c.py:9", "Found 3 errors"), ("See https",)),
        case("Success: no issues found in 4 source files", ("Success: no issues",)),
        case("a.py:1: error: One\n    x = y\n    ^\nb.py:1: error: Two", ("One", "Two"), ("    ^",)),
        case("nothing of use here", ("nothing of use here",)),
    ],
    "ruff": [
        case("a.py:1:1: F401 unused import\n  |\n  = help: Remove it\nFound 1 error.", ("a.py:1:1: F401", "Found 1 error"), ("= help",)),
        case("All checks passed!\n\n\n", ("All checks passed!",)),
    ],
    "cat-csharp": [case("using System;\n\nclass A\n{\n    public int F(int x)\n    {\n        var y = x;\n        return y;\n    }\n}\n", ("using System;", "public int F(int x)"), ("var y = x;",)), case("class A { // {\n}\n\n\n", ("class A",))],
    "dotenv": [case("# ----------\nAPI_KEY=abc\n\nDEBUG=1\n", ("API_KEY=abc", "DEBUG=1"), ("# -----",)), case("\n\n  \n", ("(no settings)",))],
    "cat-go": [case('package main\n\nfunc Sum(a, b int) int {\n\ts := a + b\n\treturn s\n}\n', ("package main", "func Sum"), ("s := a + b",)), case("package p\n\n\n\nvar x = 1", ("var x = 1",))],
    "ini": [case("; -------\n[core]\nname = x\n\n[more]\nhost: y\n", ("[core]", "name = x", "host: y"), ("; ----",)), case("\n \n", ("(no settings)",))],
    "cat-java": [case("import java.util.List;\n\npublic class A {\n    int f() {\n        int x = 1;\n        return x;\n    }\n}\n", ("import java.util.List;", "int f() {"), ("int x = 1;",)), case("// -------\npublic interface I {\n    void f();\n}\n", ("void f();",), ("// ----",))],
    "cat-javascript": [case(_JS + "\n\n// ======\n", ("export function f(a) {",), ("const b", "// ====")), case("const x = 1;\n\n\nconst y = 2;", ("const x = 1;", "const y = 2;"))],
    "cat-json": [case("[\n" + ",\n".join(f'  {{"id": {i}}}' for i in range(20)) + "\n]", ('{"id": 0}', "... 17 more items omitted (20 total) ..."), ('{"id": 9}',), 0.5), case('{"a": [1, 2], "b": {"c": null}}', ('"c": null',)), case("[\n  1,\n  2\n", ("[\n  1,\n  2\n",))],
    "cat-python": [case('import os\n\n\ndef f(a):\n    """Doc."""\n    b = a\n    return b\n\n# -----\n', ("def f(a):", '"""Doc."""'), ("b = a", "# ---")), case("x = 1\n# TODO: fix\n", ("x = 1", "# TODO: fix")), case("def broken(:\n    pass\n", ("def broken(:", "pass"))],
    "cat-rust": [case("use std::fmt;\n\nimpl A {\n    pub fn f(&self) -> u8 {\n        let x = 1;\n        x\n    }\n}\n", ("use std::fmt;", "pub fn f"), ("let x = 1;",)), case("// ------\npub struct P;\n", ("pub struct P;",), ("// ---",))],
    "cat-toml": [case("".join(f'[[package]]\nname = "p{i}"\n\n' for i in range(9)), ('name = "p0"', "more [[package]] entries omitted (9 total)"), ('name = "p8"',)), case('[a]\nb = "c"\n', ('b = "c"',))],
    "cat-typescript": [case("export interface S { x: number }\n" + _JS, ("export interface S", "export function f(a) {"), ("const b",)), case("type A = string;\n\n\n// =====\n", ("type A = string;",), ("// ===",))],
    "cat-tsx": [case("export const View = (p: P) => {\n  const x = p.x;\n  return <b>{x}</b>;\n};\n", ("export const View",), ("const x = p.x;",)), case("let a = 1;\nlet a = 1;\nlet b = 2;", ("let b = 2;",))],
    "cat-yaml": [case("a:\n  b: 1\n\nc: 2\n", ("b: 1", "c: 2")), case("key: [1, 2\n", ("key: [1, 2",))],
    "markdown": [case(_PROSE, ("# Title", "- item one", "> quoted"), ("\n\n",)), case("", ("",)), case("text\ntext\ntext\n| a | b |", ("| a | b |",))],
    "document-text": [case(_PROSE, ("# Title", "- item two"), ("\n\n",)), case("one\n\n\ntwo\nhttps://x.example", ("one", "two", "https://x.example"))],
    "cat": [case("#!/bin/sh\n\n# ======\necho a\n// -----\n----------\necho b\n", ("#!/bin/sh", "echo a", "echo b"), ("# ===", "// ---", "----------")), case("x\nx\nx\ny", ("x", "y"), ("x\nx",)), case("a\n\nError: broken\n", ("Error: broken",))],
    "docker-build": [case("#5 sha256:abc 1MB\n#6 DONE 0.1s\nStep 1/3 : FROM x\n ---> 0123456789ab\nSuccessfully built 1\n#7 ERROR: failed", ("Step 1/3", "Successfully built", "ERROR: failed"), ("sha256", "DONE", "--->")), case("\x1b[32m\x1b[0m\nStep 2/3 : RUN y", ("Step 2/3",), ("\x1b",))],
    "gradle": [case("Starting a Gradle Daemon\n" + many("> Task :a{} UP-TO-DATE", 4) + "\nBUILD SUCCESSFUL in 2s", ("BUILD SUCCESSFUL", "(×4)"), ("Starting a Gradle", ":a3")), case(many("Downloading https://r.example/{}.jar", 5) + "\nerror: x", ("error: x", "(×5)"), ("4.jar",))],
    "maven": [case("[INFO] \n[INFO] --------\n" + many("[INFO] Downloading from central: https://r.example/{}", 4) + "\nTests run: 3\n[INFO] BUILD SUCCESS", ("Tests run: 3", "BUILD SUCCESS", "(×4)"), ("-------", "example/3")), case("[ERROR] Failed to compile", ("[ERROR] Failed to compile",))],
    "github-actions": [case("2024-01-02T03:04:05.678Z ##[group]Run x\n2024-01-02T03:04:06.678Z ok\n2024-01-02T03:04:07.678Z ##[endgroup]\n2024-01-02T03:04:08.678Z ##[error]bad", ("ok", "##[error]bad"), ("2024-01-02", "##[group]")), case("##[debug]a\n##[debug]b\ndone", ("done", "(×2)"), ("##[debug]b",))],
    "docker-ps": [case("CONTAINER ID   IMAGE     STATUS         NAMES\nabc            nginx     Up 3 hours     web", ("CONTAINER ID IMAGE STATUS NAMES", "abc nginx Up 3 hours web"), (), 0.2), case("plain", ("plain",))],
    "docker-images": [case("REPOSITORY      TAG       SIZE\nnginx           latest    10MB", ("nginx latest 10MB",), (), 0.2), case("REPOSITORY\n", ("REPOSITORY",))],
    "gcc": [case("make[1]: Entering directory '/x'\n" + many("gcc -O2 -c f{}.c", 4) + "\na.c:1:2: error: bad\na.c: In file\nmake: *** [all] Error 1", ("a.c:1:2: error: bad", "*** [all] Error 1", "(×4)"), ("Entering directory", "f3.c")), case(many("f{}.c:1: warning: unused variable in this long function", 3), ("f0.c:1: warning: unused", "(2 more with the same message at: f1.c:1, f2.c:1)"), ("f1.c:1: warning",))],
    "git-status": [case('On branch main\nYour branch is up to date\nChanges not staged\n  (use "git add")\n\tmodified:   a.py\n\nno changes added to commit', ("modified:   a.py", "Changes not staged"), ("On branch", '(use "git')), case("On branch x\nnothing to commit, working tree clean\nHEAD detached at 1", ("HEAD detached",), ("nothing to commit",))],
    "git-log": [case("commit 0123456789abcdef\nAuthor: A <a@b.c>\nDate:   Mon\n\n    fix: thing\n", ("commit 0123456", "Date:", "fix: thing"), ("Author:",)), case("commit 0123456789abcdef\nMerge: a b\nDate: x\n    plain", ("Date: x", "plain"), ("Merge:",)), case(many("commit 0123456789abcdef0123456789abcdef{}\n    words of a message that goes on", 100), ("commit 0123456789abcdef0123456789abcdef0",))],
    "git-diff": [case("diff --git a/x b/x\nindex 012..345 100644\n--- a/x\n+++ b/x\n@@ -1 +1 @@\n-a\n+b", ("--- a/x", "+++ b/x", "-a", "+b"), ("index 012", "diff --git")), case("diff --git a/m b/m\nold mode 100644\nnew mode 100755", ("diff --git a/m b/m",)), case("diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1,20 +1,20 @@\n" + many(" context line number {} of the file", 12) + "\n+new", ("unchanged lines omitted", "+new"), ("number 6",))],
    "git-branch": [case("* main      0123 msg\n  feature   4567 other", ("* main 0123 msg",)), case("* main", ("* main",))],
    "java": [case('Exception in thread "main" E: x\n' + many("\tat a.B.c{}(B.java:1)", 6) + "\nCaused by: F\n\t... 3 more", ("Exception in thread", "Caused by: F", "(×6)"), ("c5(", "... 3 more")), case("quiet", ("quiet",))],
    "kubectl-get": [case(_TABLE, ("NAME STATUS AGE", "beta Error 1h"), (), 0.2), case("No resources found", ("No resources found",))],
    "eslint": [case("/a/b.js\n  1:1  error  Bad  no-bad\n\n  2:1  warning  Hm  hm\n\n2 problems", ("/a/b.js", "Bad", "Hm", "2 problems")), case("all fine", ("all fine",))],
    "tsc": [case("a.ts(1,2): error TS2304: Cannot find x\n  foo\n  ~~~\nb.ts(3,4): error TS1: y", ("error TS2304", "error TS1"), ("~~~",)), case(many("f{}.ts: error TS2304: Cannot find name that was asked for", 4), ("f0.ts: error TS2304", "(3 more with the same message at: f1.ts, f2.ts, f3.ts)"), ("f1.ts: error",))],
    "jest": [case("PASS a.test.js\n  ✓ works (3 ms)\nFAIL b.test.js\n  ● breaks\n    Expected: 1\n    Received: 2\nTests: 1 failed", ("FAIL b.test.js", "● breaks", "Expected: 1", "Tests: 1 failed"), ("✓ works", "PASS a")), case("PASS a.test.js\nTests: 3 passed", ("Tests: 3 passed",), ("PASS a",))],
    "vitest": [case(" ✓ a (2)\n × b\n   Expected 1\n Test Files  1 failed\n      Tests  1 failed\n", ("× b", "Expected 1", "Test Files"), ("✓ a",)), case("no marks", ("no marks",))],
    "prettier": [case("src/a.js 12ms (unchanged)\nsrc/b.js 3ms\n[warn] src/c.js\n[error] src/d.js: bad", ("[warn] src/c.js", "[error] src/d.js"), ("12ms", "3ms")), case("Code style issues found", ("Code style issues found",))],
    "npm": [case("npm http fetch GET 200\nnpm warn deprecated a@1\nnpm warn deprecated b@2\n\nadded 10 packages in 2s\n3 packages are looking for funding\n  run `npm fund` for details\nfound 0 vulnerabilities", ("added 10 packages", "found 0 vulnerabilities"), ("npm http", "npm fund")), case("npm ERR! code ERESOLVE", ("npm ERR! code ERESOLVE",))],
    "npx": [case("npm warn a\nnpm warn b\nNeed to install the following packages:\nOk to proceed? (y)\nError: x", ("Error: x",), ("Need to install", "Ok to proceed")), case("made it", ("made it",))],
    "pnpm": [case("Progress: resolved 1, reused 0\nPackages: +3\n+ left-pad 1.0.0\nERR_PNPM_X bad\nDone in 1s", ("+ left-pad", "ERR_PNPM_X", "Done in 1s"), ("Progress:",)), case("Already up to date", ("Already up to date",))],
    "yarn": [case("yarn install v1\n[1/4] Resolving packages...\n[2/4] Fetching\ninfo No lockfile\nsuccess Saved lockfile.\n$ tsc\nDone in 2s.", ("success Saved lockfile", "Done in 2s."), ("[1/4]", "info No", "$ tsc")), case("error An unexpected error", ("error An unexpected error",))],
    "bun": [case("bun install v1.0\n\n+ a@1.0\n3 packages installed", ("+ a@1.0", "3 packages installed"), ("bun install",)), case("error: x", ("error: x",))],
    "next": [case("  ▲ Next.js 14\n  - Local: http://localhost\ninfo  - Loaded env\nRoute (app)  Size\n┌ /  1 kB\nFailed to compile", ("Route (app)", "┌ /", "Failed to compile"), ("Next.js 14", "Local:", "info  -")), case("ready", ("ready",))],
    "turbo": [case("a:build: cache hit, replaying logs 12\nb:build: error x\n Tasks: 2 successful\n Failed: b", ("error x", "Tasks: 2", "Failed: b"), ("cache hit",)), case("a\na\nb", ("a\nb",))],
    "pip": [case("Collecting x\n  Downloading x-1.whl (3 kB)\n  Using cached y\nRequirement already satisfied: z\nSuccessfully installed x-1", ("Collecting x", "Successfully installed"), ("Downloading", "Using cached", "already satisfied")), case("ERROR: No matching distribution", ("ERROR: No matching",)), case("Package    Version\n---------- -------\npip        24.0", ("pip 24.0",))],
    "poetry": [case("Resolving dependencies... (1s)\n  - Installing a (1.0): 20%\n  - Installing b (1.0)\nerror: c", ("error: c", "Installing b (1.0)"), ("Resolving", "20%")), case("a    1.0   text  of a", ("a 1.0 text  of a",))],
    "pytest": [case("platform linux\nrootdir: /x\ncollecting ...\na.py ..... [100%]\nFAILED a.py::b - assert 1\nE   assert 1\n=== 1 failed, 4 passed ===", ("FAILED a.py::b", "1 failed, 4 passed"), ("platform linux", "rootdir", "[100%]")), case("nothing matched", ("nothing matched",)), case("==== test session starts ====\nplugins: x\n==== 5 passed ====", ("5 passed",), ("plugins:",))],
    "ps": [case("USER       PID   CMD\nroot       1     init", ("USER PID CMD", "root 1 init"), (), 0.2), case("x", ("x",))],
    "df": [case("Filesystem      Size   Used\n/dev/sda1       10G    3G", ("Filesystem Size Used", "/dev/sda1 10G 3G"), (), 0.2), case("4.0K\t./a", ("4.0K\t./a",))],
    "ls-long": [case("total 8\n-rw-r--r--  1 a    staff   123 Jan  1 00:00 x\ndrwxr-xr-x  2 a    staff    64 Jan  1 00:00 y", ("total 8", "-rw-r--r-- 1 a staff 123", "drwxr-xr-x 2 a staff 64")), case("a\nb", ("a", "b"))],
    "generic": [
        case("\x1b[31mred\x1b[0m\n\n\nred\nred\nred", ("red (×4)",), ("\x1b",)),
        case("2024-01-02T03:04:05Z a long enough line of log\n2024-01-02T03:04:06Z another long line of log\n2024-01-02T03:05:06Z the last line of this log", ("2024-01-02T03:04:05Z a", "+1s another", "+1m the last")),
        case(many("src/deep/folder/name/file{}.txt", 6), ("src/deep/folder/name/ (6 entries):", "file5.txt"), ("name/file",), 0.4),
        case("\n".join(str(i) for i in range(1000, 1040)), ("1000-1039",), ("1020",), 0.9),
        case("kept\n\nwarning: this\n   \nerror: that", ("kept", "warning: this", "error: that")),
    ],
}
