"""Predicates on authors, paths and file samples."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import json_truthy

#: What names a bot among authors.
BOT_PATTERNS = (
    r"\bdependabot\b", r"\brenovate\b", r"\bsnyk-bot\b", r"\bgithub-actions\b", r"\bmergify\b",
    r"\bpre-commit-ci\b", r"\bwhitesource\b", r"\bgreenkeeper\b", r"\bimgbot\b", r"\b\[bot\]\b",
)
#: Folders of tests, folders that no walk enters, folders of libraries.
TEST_DIRS = ("test", "tests", "spec", "specs", "__tests__")
SKIP_DIRS = (
    ".git", "node_modules", "vendor", "dist", "build", ".venv", "venv", "bower_components", "__pycache__",
    ".tox", "Pods", "Carthage", ".gradle", "target", "bin", "obj", "packages",
)
LIBRARY_DIRS = ("lib", "libs", "library", "libraries")
#: Extensions of source files that are sampled, and of those that are counted besides.
SAMPLE_EXTENSIONS = (
    ".py", ".js", ".jsx", ".ts", ".tsx", ".java", ".go", ".rs", ".rb", ".php", ".cs", ".swift", ".kt", ".scala", ".vue", ".svelte",
)
CODE_EXTENSIONS = SAMPLE_EXTENSIONS + (
    ".c", ".cc", ".cpp", ".h", ".hpp", ".m", ".mm", ".cshtml", ".aspx", ".jsp", ".dart", ".groovy", ".kts", ".fs", ".fsx",
)
#: Endings and beginnings of test files, by the strict rule and by the loose one.
TEST_ENDS = (
    "_test.py", "_test.go", "_test.rb", ".spec.ts", ".spec.tsx", ".spec.js", ".spec.jsx", ".test.ts", ".test.tsx",
    ".test.js", ".test.jsx", "tests.cs", "test.cs", "test.java",
)
TREE_TEST_ENDS = ("_test.py", ".spec.ts", ".spec.js", "_test.go", "test.java")
#: Files and folders of continuous integration.
CI_FILES = (
    ".gitlab-ci.yml", ".travis.yml", ".drone.yml", ".woodpecker.yml", "jenkinsfile", "azure-pipelines.yml", "azure-pipelines.yaml",
    "bitbucket-pipelines.yml", "cloudbuild.yaml", "cloudbuild.yml", "buildkite.yml", "codebuild.yml",
)
CI_DIRS = (".github/workflows", ".circleci", ".buildkite", ".woodpecker")
#: Configuration files of test runners, manifests that may name one, and how they name it.
RUNNER_FILES = (
    "jest.config.js", "jest.config.cjs", "jest.config.mjs", "jest.config.ts", "vitest.config.js", "vitest.config.ts", "vitest.config.mjs",
    "karma.conf.js", "karma.conf.ts", "mocha.opts", ".mocharc.js", ".mocharc.cjs", ".mocharc.json", ".mocharc.yml", "ava.config.js",
    "ava.config.cjs", "pytest.ini", "phpunit.xml", "phpunit.xml.dist", "tox.ini", ".rspec", "nose2.cfg", "conftest.py",
)
RUNNER_MANIFESTS = ("package.json", "composer.json", "pyproject.toml", "pom.xml", "setup.cfg")
RUNNER_MARKERS = (
    r"\bjest\b", r"\bvitest\b", r"\bmocha\b", r"\bava\b", r"\bpytest\b", r"\bphpunit\b", r"\bnunit\b", r"\bxunit\b", r"\bmstest\b",
    r"Microsoft\.NET\.Test\.Sdk", r"Microsoft\.VisualStudio\.Test", r"go test",
)
GRADLE_MARKERS = ("junit", "testimplementation", "usebjunit")


def _any(parts: list[Column]) -> Column:
    return reduce(or_, parts)


def _has(text: Column, *words: str) -> Column:
    return _any([F.contains(text, F.lit(w)) for w in words])


def is_bot_author(name: Column, email: Column) -> Column:
    return F.concat_ws(" ", name, email).rlike("(?i)" + "|".join(BOT_PATTERNS))


def is_bot_login(login: Column, kind: Column) -> Column:
    """A platform's own bot type decides; else a login that holds 'bot' or is a known bot's name; an empty login is none."""
    return F.when(kind == "Bot", True).when(login.isNull() | (login == ""), False).otherwise(F.contains(F.lower(login), F.lit("bot")) | is_bot_author(login, F.lit("")))


def folders(path: Column) -> Column:
    """The folders above a file."""
    parts = F.split(path, "/")
    return F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))


def file_name(path: Column) -> Column:
    return F.lower(F.element_at(F.split(path, "/"), -1))


def extension(path: Column) -> Column:
    """The last ending of a file's name, lower-cased; empty if there is none but at the name's start."""
    return F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1)


def is_walked(path: Column) -> Column:
    """Whether no folder above the file is one that walks skip."""
    return ~F.arrays_overlap(folders(path), F.array(*map(F.lit, SKIP_DIRS)))


def is_code(path: Column) -> Column:
    return extension(path).isin(*CODE_EXTENSIONS)


def is_test_path(path: Column) -> Column:
    """The strict rule: a part of the path is a test folder's name, or the name begins or ends like a test's."""
    lowered = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    name = F.element_at(F.split(lowered, "/"), -1)
    return F.arrays_overlap(F.split(lowered, "/"), F.array(*map(F.lit, TEST_DIRS))) | name.startswith("test_") | _any([name.endswith(e) for e in TEST_ENDS])


def shows_tests(path: Column, repo: Column | None = None) -> Column:
    """The loose rule: a folder's name, the repository's included, holds a hint, or the name is a test's."""
    above = F.transform(folders(path), F.lower)
    hints = lambda d: _has(d, *TEST_DIRS)
    name = file_name(path)
    found = F.exists(above, hints) | name.startswith("test_") | _any([name.endswith(e) for e in TREE_TEST_ENDS])
    return found if repo is None else found | hints(F.lower(F.element_at(F.split(repo, "/"), -1)))


def shows_ci(path: Column) -> Column:
    """A folder of continuous integration at the root, or one of its files in a walked folder."""
    name = file_name(path)
    root = _any([path.startswith(d + "/") for d in CI_DIRS])
    return root | (is_walked(path) & (name.isin(*CI_FILES) | name.startswith("jenkinsfile")))


def names_runner(text: Column) -> Column:
    return text.rlike("(?i)" + "|".join(RUNNER_MARKERS))


def shows_runner(path: Column, sample: Column) -> Column:
    """A test runner's configuration, or a manifest that names one in its first characters."""
    name, text = file_name(path), F.coalesce(sample, F.lit(""))
    return (
        name.isin(*RUNNER_FILES)
        | (name.endswith(".csproj") & names_runner(F.left(text, F.lit(20_000))))
        | (name.isin(*RUNNER_MANIFESTS) & names_runner(F.left(text, F.lit(40_000))))
        | (name.isin("build.gradle", "build.gradle.kts") & _has(F.lower(F.left(text, F.lit(40_000))), *GRADLE_MARKERS))
    )


def shows_library(path: Column, sample: Column, repo: Column | None = None) -> Column:
    """A library folder, the repository's own name included, or a manifest of something that can be published."""
    name, text = file_name(path), F.coalesce(sample, F.lit(""))
    low, short = F.lower(F.left(text, F.lit(40_000))), F.lower(F.left(text, F.lit(20_000)))
    project = _has(short, "<outputtype>library</outputtype>") | (
        _has(short, "microsoft.net.sdk") & ~_has(short, "<outputtype>exe</outputtype>", "<outputtype>winexe</outputtype>")
    )
    found = (
        F.exists(F.transform(folders(path), F.lower), lambda d: d.isin(*LIBRARY_DIRS))
        | (name.endswith(".csproj") & project)
        | ((name == "package.json") & json_truthy(F.left(text, F.lit(40_000)), "main", "exports", "module"))
        | ((name == "setup.py") & _has(low, "setup(") & _has(low, "find_packages", "packages=", "py_modules"))
        | ((name == "pyproject.toml") & _has(low, "[project]", "[tool.poetry]", "packages ="))
        | name.endswith(".gemspec")
    )
    return found if repo is None else found | F.lower(F.element_at(F.split(repo, "/"), -1)).isin(*LIBRARY_DIRS)


def is_sampled(path: Column, size: Column, sample: Column) -> Column:
    """Whether a source file may be quoted as evidence: small, not about tests, not empty."""
    return extension(path).isin(*SAMPLE_EXTENSIONS) & ~_has(F.lower(path), "test") & (size <= 250_000) & (F.length(sample) > 0)


def plain_name(name: str) -> str:
    """A single name as `scalars.safe_name` makes it of a column."""
    return re.sub(r"[^\w.\-]+", "_", name)
