"""Repository profiles: what a repository is built with, by rules over paths and contents; entry points; folders."""

from __future__ import annotations

import json
import re
import tomllib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from condense.functions.text import file_name
from condense.operators.repo import is_fixture, language_stats, repository_stats
from condense.shipping import ship


@dataclass(frozen=True)
class Detector:
    category: str
    name: str
    basenames: tuple[str, ...] = ()
    path: str | None = None
    #: found in the first 256 KiB of a file that basenames or path name
    content: str | None = None


def _many(category: str, **named: str) -> tuple[Detector, ...]:
    """name='file another|path-pattern|content-pattern'; underscores in names are blanks."""
    out = []
    for name, spec in named.items():
        files, path, content = (*spec.split("|", 2), None, None)[:3]
        out.append(Detector(category, name.replace("_", " "), tuple(files.split()), path or None, content or None))
    return tuple(out)


PY, JS = "pyproject.toml requirements.txt setup.py setup.cfg Pipfile", "package.json"
#: File names and words by which tools are known.
DETECTORS: tuple[Detector, ...] = (
    *_many("build system", setuptools="pyproject.toml setup.py||setuptools", hatch="pyproject.toml||hatchling", poetry="pyproject.toml||\\[tool\\.poetry\\]", flit="pyproject.toml||flit_core", maven="pom.xml", gradle="build.gradle build.gradle.kts settings.gradle", make="Makefile makefile GNUmakefile", cmake="CMakeLists.txt", bazel="BUILD.bazel WORKSPACE MODULE.bazel", cargo="Cargo.toml", go_modules="go.mod", meson="meson.build", vite="vite.config.ts vite.config.js", webpack="webpack.config.js webpack.config.ts", msbuild="|\\.(csproj)?(sln)?$"),
    *_many("ci", GitHub_Actions="|^\\.github/workflows/[^/]+\\.ya?ml$", GitLab_CI=".gitlab-ci.yml", Jenkins="Jenkinsfile", CircleCI="|^\\.circleci/config\\.yml$", Travis=".travis.yml", Azure_Pipelines="azure-pipelines.yml", Buildkite="|^\\.buildkite/"),
    *_many("configuration", editorconfig=".editorconfig", pre_commit=".pre-commit-config.yaml", eslint=".eslintrc .eslintrc.js .eslintrc.json eslint.config.js", prettier=".prettierrc .prettierrc.json", ruff="ruff.toml pyproject.toml||\\[tool\\.ruff", mypy="mypy.ini pyproject.toml||mypy", dotenv=".env .env.example", tsconfig="tsconfig.json", renovate="renovate.json", dependabot="|^\\.github/dependabot\\.ya?ml$"),
    *_many("container", Docker="Dockerfile Containerfile", Compose="docker-compose.yml docker-compose.yaml compose.yaml compose.yml", Kubernetes="|\\.ya?ml$|(?m)^kind: (Deployment|Service|StatefulSet|Ingress)", Helm="Chart.yaml", Dev_Container="devcontainer.json"),
    *_many("database", PostgreSQL=f"{PY} {JS}||psycopg|asyncpg|\"pg\"", MySQL=f"{PY} {JS}||mysqlclient|pymysql|\"mysql2?\"", SQLite=f"{PY} {JS}||aiosqlite|better-sqlite3|\"sqlite3\"", MongoDB=f"{PY} {JS}||pymongo|motor|mongoose", Redis=f"{PY} {JS}||\\bredis\\b", SQLAlchemy=f"{PY}||(?i)sqlalchemy", Prisma="schema.prisma", Alembic="alembic.ini", Flyway="|db/migration/V\\d+.*\\.sql$", Elasticsearch=f"{PY} {JS}||elasticsearch", Kafka=f"{PY} {JS}||kafka", DuckDB=f"{PY} {JS}||duckdb"),
    *_many("framework", Flask=f"{PY}||(?i)\\bflask\\b", Django=f"{PY} manage.py||(?i)django", FastAPI=f"{PY}||(?i)fastapi", React=f"{JS}||\"react\"", Vue=f"{JS}||\"vue\"", Angular="angular.json", Svelte=f"{JS}||\"svelte\"", Next_js="next.config.js next.config.mjs next.config.ts", Express=f"{JS}||\"express\"", NestJS=f"{JS}||@nestjs/core", Spring_Boot="pom.xml build.gradle build.gradle.kts||spring-boot", Rails="Gemfile||\\brails\\b", Gin="go.mod||gin-gonic/gin", Actix="Cargo.toml||actix-web", PySpark=f"{PY}||(?i)pyspark"),
    *_many("package manager", pip="requirements.txt", Poetry="poetry.lock", uv="uv.lock", pipenv="Pipfile.lock Pipfile", conda="environment.yml", npm="package-lock.json", Yarn="yarn.lock", pnpm="pnpm-lock.yaml", Bun="bun.lockb bun.lock", Cargo="Cargo.lock", Go="go.sum", Bundler="Gemfile.lock", Composer="composer.lock"),
    *_many("test", pytest=f"pytest.ini conftest.py {PY}||pytest", unittest="|test_[^/]*\\.py$|import unittest", tox="tox.ini", Jest=f"jest.config.js jest.config.ts {JS}||\"jest\"", Vitest=f"vitest.config.ts vitest.config.js {JS}||\"vitest\"", Playwright="playwright.config.ts playwright.config.js", Cypress="cypress.config.js cypress.config.ts", JUnit="pom.xml build.gradle build.gradle.kts||junit", Go_test="|_test\\.go$", RSpec=".rspec"),
)


def detections(files: DataFrame, rules: tuple[Detector, ...] = DETECTORS) -> DataFrame:
    """(category, name, evidence): each once, with the first path that shows it; files(path, text), fixtures left out.

    One pass over the files: each file tests all rules by its name before any content is searched.
    """
    name, head = file_name(F.col("path")), F.substring(F.coalesce("text", F.lit("")), 1, 256 * 1024)
    hits = []
    for rule in rules:
        named = F.lit(False)
        if rule.basenames:
            named = named | name.isin(*rule.basenames)
        if rule.path:
            named = named | F.col("path").rlike(rule.path)
        shown = named & head.rlike(rule.content) if rule.content else named
        hits.append(F.when(shown, F.struct(F.lit(rule.category).alias("category"), F.lit(rule.name).alias("name"))))
    rows = files.where(~is_fixture(F.col("path"))).select("path", F.explode(F.array_compact(F.array(*hits))).alias("h"))
    return rows.groupBy("h.category", "h.name").agg(F.min("path").alias("evidence")).orderBy("category", "name")


def _entry_points(path: str, text: str | None) -> list[dict]:
    name, folder = path.rpartition("/")[2], path.rpartition("/")[0]
    text = text or ""
    out: list[dict] = []
    add = lambda kind, what: out.append({"kind": kind, "name": what})
    try:
        if name == "pyproject.toml":
            data = tomllib.loads(text)
            for n in {**data.get("project", {}).get("scripts", {}), **data.get("tool", {}).get("poetry", {}).get("scripts", {})}:
                add("script", n)
        elif name == "package.json":
            data = json.loads(text)
            if isinstance(data.get("main"), str):
                add("main", data["main"])
            bins = data.get("bin", {})
            for n in [data.get("name", "bin")] if isinstance(bins, str) else bins:
                add("bin", n)
        elif name == "Cargo.toml":
            for b in tomllib.loads(text).get("bin", []):
                add("bin", b.get("name", ""))
        elif name.endswith(".go") and re.search(r"(?m)^package main\b", text) and re.search(r"(?m)^func main\(\)", text):
            add("main", path)
        elif name.endswith(".rs") and name == "main.rs":
            add("main", path)
        elif name.endswith(".py") and not folder and re.search(r"(?m)^if __name__ == ['\"]__main__['\"]:", text):
            add("module", path)
    except (ValueError, AttributeError, TypeError):
        return []
    return out


def entry_points(files: DataFrame) -> DataFrame:
    """(path, kind, name): scripts and binaries of manifests, Go and Rust mains, guarded Python modules at the root."""
    ship(files.sparkSession)

    def apply(batches):
        for batch in batches:
            rows = [(p, e["kind"], e["name"]) for p, t in zip(batch["path"].to_pylist(), batch["text"].to_pylist(), strict=True) for e in _entry_points(p, t)]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["path", "kind", "name"])

    wanted = file_name(F.col("path")).isin("pyproject.toml", "package.json", "Cargo.toml") | F.col("path").rlike(r"\.(go|rs|py)$")
    return files.where(wanted & ~is_fixture(F.col("path"))).select("path", "text").mapInArrow(apply, "path string, kind string, name string")


KNOWN_FOLDERS = ("src", "lib", "app", "apps", "packages", "services", "cmd", "internal", "pkg", "tests", "test", "docs", "scripts", "tools", "examples", "config", "deploy", "infra", "migrations")
MANIFESTS = ("package.json", "pyproject.toml", "go.mod", "Cargo.toml", "pom.xml", "Dockerfile", "build.gradle")


def important_folders(files: DataFrame) -> DataFrame:
    """(folder, files) of well-known top folders."""
    top = F.element_at(F.split("path", "/"), 1)
    return files.where(F.col("path").contains("/") & top.isin(*KNOWN_FOLDERS)).groupBy(top.alias("folder")).agg(F.count("*").alias("files")).orderBy(F.desc("files"), "folder")


def services(files: DataFrame) -> DataFrame:
    """(service, manifest): folders with a manifest of their own, below the root; the first by path."""
    service = F.regexp_replace("path", "/[^/]*$", "")
    return files.where(F.col("path").contains("/") & file_name(F.col("path")).isin(*MANIFESTS) & ~is_fixture(F.col("path"))).groupBy(service.alias("service")).agg(F.min("path").alias("manifest")).orderBy("service")


def profile(files: DataFrame) -> dict[str, DataFrame]:
    """All parts of a repository's profile."""
    return {"languages": language_stats(files), "detections": detections(files), "entry_points": entry_points(files), "folders": important_folders(files), "services": services(files), "statistics": repository_stats(files)}
