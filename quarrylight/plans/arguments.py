"""What a run is asked for: checks before anything is read, and the run's name."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import datetime, timezone

from ..functions.predicates import plain_name


@dataclass(frozen=True)
class RunArguments:
    """The targets and settings of a run. Secrets are never among them: a classifier's key comes from the environment."""

    github_orgs: tuple[str, ...] = ()
    github_repos: tuple[str, ...] = ()
    github_accessible: bool = False
    gitlab_groups: tuple[str, ...] = ()
    gitlab_repos: tuple[str, ...] = ()
    gitlab_accessible: bool = False
    offline: bool = False
    clones: str = ""
    classify: bool = False
    key_env: str = "CLASSIFIER_API_KEY"
    has_tokens: bool = False
    environment: Mapping[str, str] = field(default_factory=lambda: os.environ)

    def hosted(self) -> bool:
        """Whether any target lies at a hosted service."""
        return bool(self.github_orgs or self.github_repos or self.github_accessible or self.gitlab_groups or self.gitlab_repos or self.gitlab_accessible)

    def check(self) -> "RunArguments":
        """These arguments, if they go together; else a ValueError that says what doesn't."""
        if self.offline and not self.clones:
            raise ValueError("an offline run needs a folder of clones")
        if self.offline and self.hosted():
            raise ValueError("an offline run has no hosted targets")
        if not self.offline and not self.has_tokens:
            raise ValueError("hosted targets need tokens")
        if self.classify and not self.environment.get(self.key_env, "").strip():
            raise ValueError(f"classification needs {self.key_env} in the environment, never as an argument")
        return self

    def label(self) -> str:
        """What the run is named after: the clones' folder, or the first of its targets by kind."""
        if self.offline:
            return os.path.basename(self.clones.rstrip("/"))
        named = [
            self.github_orgs[:1], self.gitlab_groups[:1], ("github-accessible",) * self.github_accessible, ("gitlab-accessible",) * self.gitlab_accessible,
            tuple(n.replace("/", "_") for n in self.github_repos[:1]), tuple(n.replace("/", "_") for n in self.gitlab_repos[:1]), ("repos",),
        ]
        return next(n[0] for n in named if n)

    def folder(self, now: datetime) -> str:
        """The name of the run's folder, with its time in UTC."""
        return f"raw-extract-{plain_name(self.label())}-{now.astimezone(timezone.utc):%Y%m%dT%H%M%SZ}"
