"""Schemas of what is read and of the summary. The names of fields are fixed values."""

from __future__ import annotations

TARGETS = "seq long, platform string, org string, full_name string, meta string"
COMMITS = (
    "repo string, log_pos long, sha string, author_name string, author_email string, author_date string, subject string, body string, "
    "files array<struct<path:string,additions:long,deletions:long>>"
)
COMMIT_LINES = "repo string, log_pos long, line_no long, line string, error string"
COMMIT_RECORDS = "repo string, log_pos long, record string, error string"
FILES = "repo string, path string, bytes long, lines long, sample string, error string"
LINE_COUNTS = "repo string, language string, code long, error string"
CLONE_FACTS = "repo string, default_branch string, error string"
LANGUAGES = "full_name string, map_pos int, language string, value double"
PERSON = "struct<login:string,__typename:string>"
PAGE = "struct<hasNextPage:boolean>"
MERGED_PRS = (
    "number int, title string, bodyText string, url string, createdAt string, updatedAt string, mergedAt string, changedFiles int, additions int, deletions int, "
    f"totalCommentsCount int, author {PERSON}, labels struct<nodes:array<struct<name:string>>>, commits struct<totalCount:int>, "
    f"files struct<pageInfo:{PAGE},nodes:array<struct<path:string>>>, "
    "closingIssuesReferences struct<nodes:array<struct<number:int,title:string,url:string>>>, "
    f"comments struct<pageInfo:{PAGE},nodes:array<struct<bodyText:string,createdAt:string,author:{PERSON}>>>, "
    f"reviews struct<pageInfo:{PAGE},nodes:array<struct<state:string,bodyText:string,createdAt:string,author:{PERSON}>>>, "
    f"reviewThreads struct<pageInfo:{PAGE},nodes:array<struct<isResolved:boolean,comments:struct<pageInfo:{PAGE},"
    f"nodes:array<struct<bodyText:string,path:string,createdAt:string,author:{PERSON}>>>>>>"
)
#: What is read of a hosted repository, by platform.
GITHUB_REPO = "id long, full_name string, name string, created_at string, updated_at string, language string, size double, default_branch string, archived boolean, owner struct<login:string,type:string>"
GITLAB_PROJECT = "id long, path_with_namespace string, name string, created_at string, last_activity_at string, default_branch string, archived boolean, statistics struct<repository_size:double>"
ACCOUNT = "id long, login string, type string, name string, email string, contributions long"
MEMBER = "id long, username string, name string, state string, access_level int"
GROUP = "id long, name string, path string, full_path string"
INSTALLATION = "id long, account struct<login:string,type:string>, repository_selection string, suspended_at string"
MERGE_REQUEST = "iid long, state string, title string, merged_at string, updated_at string, author struct<username:string>"
MERGED_MRS = "iid long, state string, merged_at string, author struct<username:string>, notes array<string>, changes array<string>"
LOG_LINES = "seq long, line string"
#: The summary: one row per repository, in this order of columns, with what a missing value becomes.
SUMMARY = {
    "org": "string", "project_name": "string", "repo": "string", "merged_prs": "long", "languages_breakdown": "string",
    "repo_created_at": "string", "last_commit_date": "string", "loc": "long", "primary_language": "string", "size_kb": "long",
    "default_branch": "string", "total_commits": "long", "first_commit": "string", "span_days": "long", "recency_days": "long",
    "contributor_count": "long", "human_authors": "long", "bot_authors": "long", "bot_commit_ratio": "double", "total_files": "long",
    "has_tests": "boolean", "has_test_runner": "boolean", "has_ci_cd": "boolean", "test_source_loc_pct": "double",
    "has_library_code": "boolean", "company_period": "string", "codebase_description": "string", "industry_domain": "string",
    "vibe_code_signals": "string", "repo_type": "string", "llm_analysis_error": "string", "error": "string",
}
SUMMARY_DEFAULTS = {"merged_prs": 0, "loc": 0, "total_files": 0, "has_tests": False, "has_test_runner": False, "has_ci_cd": False, "has_library_code": False}
