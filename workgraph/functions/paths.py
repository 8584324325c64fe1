"""Paths, hashes, languages and source references as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from workgraph.functions.ids import col

# File extensions and whole names by language.
EXTENSIONS = {
    "go": ["go"], "java": ["java"], "kotlin": ["kt", "kts"],
    "javascript": ["js", "mjs", "cjs", "jsx"], "typescript": ["ts", "mts", "cts"], "tsx": ["tsx"],
    "gherkin": ["feature"], "yaml": ["yaml", "yml"], "sql": ["sql"], "python": ["py"], "rust": ["rs"],
    "protobuf": ["proto"], "json": ["json"], "markdown": ["md", "markdown"], "shell": ["sh", "bash", "zsh"],
    "html": ["html", "htm"], "css": ["css"], "toml": ["toml"], "hcl": ["tf", "hcl"],
}
WHOLE_NAMES = {"dockerfile": ["dockerfile"], "make": ["makefile", "gnumakefile"], "gomod": ["go.mod", "go.sum", "go.work"]}
# Languages whose files are configuration.
CONFIG_LANGUAGES = ["yaml", "json", "toml", "hcl", "dockerfile", "make", "gomod", "shell"]
# Extensions and names of configuration and documentation files.
CONFIG_EXTENSIONS = ["yaml", "yml", "toml", "json", "ini", "md", "sh", "mod", "sum", "lock", "cfg", "conf"]
CONFIG_NAMES = ["makefile", "dockerfile", ".gitignore", "go.mod", "go.sum"]


def basename(path) -> Column:
    return F.substring_index(col(path), "/", -1)


def dirname(path) -> Column:
    path = col(path)
    return F.when(F.contains(path, F.lit("/")), F.regexp_extract(path, r"^(.*)/[^/]*$", 1)).otherwise(F.lit("."))


def extension(path) -> Column:
    return F.regexp_extract(F.lower(basename(path)), r"\.([^.]*)$", 1)


def detect_language(path) -> Column:
    base, ext = F.lower(basename(path)), extension(path)
    out = F.lit("")
    for language, exts in EXTENSIONS.items():
        out = F.when(ext.isin(exts), F.lit(language)).otherwise(out)
    for language, names in WHOLE_NAMES.items():
        out = F.when(base.isin(names), F.lit(language)).otherwise(out)
    return out


def is_test_path(path, language=None) -> Column:
    base = F.lower(basename(path))
    language = detect_language(path) if language is None else col(language)
    return base.rlike(r"_test\.|\.test\.|_spec\.|\.spec\.|^test_") | (language == "gherkin")


def guess_kind(path, language=None) -> Column:
    language = detect_language(path) if language is None else col(language)
    return (F.when(is_test_path(path, language), F.lit("test"))
            .when(language.isin(CONFIG_LANGUAGES), F.lit("config")).otherwise(F.lit("behavior")))


def file_category(path) -> Column:
    base, rooted = F.lower(basename(path)), F.concat(F.lit("/"), F.lower(col(path)))
    test = base.rlike(r"_test\.go$|\.test\.|\.spec\.|^test_|\.feature$") | \
        rooted.rlike(r"/tests/|/e2e/|/testdata/")
    return (F.when(test, F.lit("test file"))
            .when(extension(path).isin(CONFIG_EXTENSIONS) | base.isin(CONFIG_NAMES), F.lit("config/build/docs file"))
            .otherwise(F.lit("source file")))


def renamed_path(raw) -> Column:
    """The new path of ``dir/{old => new}/file`` and ``old => new``."""
    raw = col(raw)
    braces = r"(?s)^([^{]*)\{(?:(?!\}| => ).)* => ([^}]*)\}(.*)$"
    return (F.when(raw.rlike(braces), F.regexp_replace(raw, braces, "$1$2$3"))
            .when(F.contains(raw, F.lit(" => ")), F.trim(F.regexp_replace(raw, r"(?s)^.*? => ", "")))
            .otherwise(raw))


def file_path(status, old_path, new_path) -> Column:
    return F.when((col(status) == "deleted") | (F.coalesce(col(new_path), F.lit("")) == ""), col(old_path)) \
        .otherwise(col(new_path))


def file_status(renamed, copied, added, deleted) -> Column:
    return (F.when(col(renamed), F.lit("renamed")).when(col(copied), F.lit("copied"))
            .when(col(added), F.lit("added")).when(col(deleted), F.lit("deleted"))
            .otherwise(F.lit("modified")))


def file_id(old_path, new_path) -> Column:
    return F.substring(F.sha1(F.concat(col(old_path), F.lit("\0"), col(new_path))), 1, 12)


def hunk_id(path, body) -> Column:
    return F.sha1(F.concat(col(path), F.lit("\n"), col(body)))


def summary_key(*parts) -> Column:
    """A digest of byte-length-prefixed parts, so no two part lists collide by joining."""
    pieces = []
    for part in parts:
        text = F.coalesce(col(part), F.lit(""))
        pieces += [F.octet_length(text).cast("string"), F.lit(":"), text]
    return F.sha2(F.concat(*pieces), 256)


def normalize_remote(ref) -> Column:
    """Equivalent clone addresses in one form: host and path, lower-cased."""
    ref = F.regexp_replace(F.regexp_replace(F.trim(col(ref)), r"/$", ""), r"\.git$", "")
    scp = r"^[\w.+-]+@([\w.-]+):/?(.+)$"
    url = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/]+)/?([^?#]*).*$"
    joined = lambda p: F.lower(F.concat(F.regexp_extract(ref, p, 1), F.lit("/"), F.regexp_extract(ref, p, 2)))
    return F.when(ref.rlike(scp), joined(scp)).when(ref.rlike(url), joined(url)).otherwise(ref)


def repo_key(ref) -> Column:
    return F.substring(F.sha1(normalize_remote(ref)), 1, 16)


def short_hash(text) -> Column:
    return F.substring(F.sha1(col(text)), 1, 8)


def slug(text) -> Column:
    return F.regexp_replace(F.lower(col(text)), r"[^a-z0-9]", "-")


def session_id(kind, owner, repo, number, ref, patch_path) -> Column:
    """The stable id of a review source; NULL where the caller must mint a random one."""
    kind, has = col(kind), lambda c: F.coalesce(col(c), F.lit("")) != ""
    return (F.when((kind == "pr") & has(owner) & has(repo),
                   F.concat(F.lit("pr-"), slug(owner), F.lit("-"), slug(repo), F.lit("-"), col(number).cast("string")))
            .when((kind == "range") & has(ref), F.concat(F.lit("range-"), short_hash(ref)))
            .when((kind == "commit") & has(ref), F.concat(F.lit("commit-"), short_hash(ref)))
            .when((kind == "patch") & has(patch_path), F.concat(F.lit("patch-"), short_hash(patch_path)))
            .when(kind == "worktree", F.lit("worktree")))


def session_title(kind, ref, patch_path, pr_title, owner, repo, number) -> Column:
    kind = col(kind)
    number_text = F.concat(F.lit("PR #"), col(number).cast("string"), F.lit(" "), col(owner), F.lit("/"), col(repo))
    return (F.when(kind == "worktree", F.lit("Worktree"))
            .when(kind == "range", F.concat(F.lit("Diff "), col(ref)))
            .when(kind == "commit", F.concat(F.lit("Commit "), col(ref)))
            .when(kind == "patch", F.concat(F.lit("Patch "), basename(patch_path)))
            .when((kind == "pr") & (F.coalesce(col(pr_title), F.lit("")) != ""), col(pr_title))
            .when((kind == "pr") & col(number).isNotNull(), number_text)
            .when(kind == "pr", F.lit("Pull request")).otherwise(F.lit("Review")))


def source_summary(kind, ref, patch_path, owner, repo, number) -> Column:
    kind = col(kind)
    pull = F.concat(F.lit("pr "), col(owner), F.lit("/"), col(repo), F.lit("#"), col(number).cast("string"))
    return (F.when(kind.isin("range", "commit"), F.concat(kind, F.lit(" "), col(ref)))
            .when(kind == "patch", F.concat(F.lit("patch "), basename(patch_path)))
            .when((kind == "pr") & col(number).isNotNull(), pull).otherwise(kind))


def split_range_ref(ref) -> Column:
    """``A..B`` or ``A...B`` as (left, right, merge_base); NULL for anything else."""
    ref = col(ref)
    three, two = r"(?s)^(.*?)\.\.\.(.*)$", r"(?s)^(.*?)\.\.(.*)$"
    pick = lambda p, mb: F.struct(F.regexp_extract(ref, p, 1).alias("left"), F.regexp_extract(ref, p, 2).alias("right"),
                                  F.lit(mb).alias("merge_base"))
    return F.when(ref.rlike(three), pick(three, True)).when(ref.rlike(two), pick(two, False))


def side_revisions(kind, ref, base_sha, head_sha, merge_base_sha) -> Column:
    """(old_rev, new_rev, from_worktree) of a review source; NULL when it has none."""
    kind, parts = col(kind), split_range_ref(ref)
    pair = lambda old, new, wt: F.struct(old.alias("old_rev"), new.alias("new_rev"), F.lit(wt).alias("from_worktree"))
    full = lambda c: F.coalesce(c, F.lit("")) != ""
    old = F.when(parts["merge_base"], col(merge_base_sha)).otherwise(parts["left"])
    return (F.when(kind == "worktree", pair(F.lit("HEAD"), F.lit(""), True))
            .when(kind == "commit", pair(F.concat(col(ref), F.lit("^")), col(ref), False))
            .when((kind == "range") & full(parts["left"]) & full(parts["right"]) & full(old),
                  pair(old, parts["right"], False))
            .when((kind == "pr") & full(col(base_sha)) & full(col(head_sha)), pair(col(base_sha), col(head_sha), False)))


def owner_repo(remote) -> Column:
    """(owner, repo) of a clone address; NULL when it has neither."""
    remote = F.regexp_replace(F.regexp_replace(F.trim(col(remote)), r"\.git$", ""), r"/$", "")
    path = F.when(F.contains(remote, F.lit("://")), F.regexp_extract(remote, r"^[^:]+://[^/]*/([^?#]*)", 1)) \
        .when(F.contains(remote, F.lit("@")), F.regexp_extract(remote, r"^[^:]*:(.*)$", 1))
    tail = r"(?:^|/)([^/]+)/([^/]+)$"
    return F.when(path.rlike(tail), F.struct(F.regexp_extract(path, tail, 1).alias("owner"),
                                             F.regexp_extract(path, tail, 2).alias("repo")))


def parse_pr_ref(text, origin=None) -> Column:
    """(host, owner, repo, number, url) of a pull-request address, ``o/r#n``, or a number with an origin."""
    text = F.trim(col(text))
    url = r"^https?://([^/]+)/([^/]+)/([^/]+)/pull/(\d+)(?:/.*)?$"
    short = r"^([\w.-]+)/([\w.-]+)#(\d+)$"
    bare = r"^#?(\d+)$"
    make = lambda host, owner, repo, number, link: F.struct(
        host.alias("host"), owner.alias("owner"), repo.alias("repo"), number.try_cast("bigint").alias("number"),
        link.alias("url"))
    get = lambda p, i: F.regexp_extract(text, p, i)
    out = F.when(text.rlike(url), make(get(url, 1), get(url, 2), F.regexp_replace(get(url, 3), r"\.git$", ""),
                                       get(url, 4), text)) \
        .when(text.rlike(short), make(F.lit("github.com"), get(short, 1), get(short, 2), get(short, 3), F.lit("")))
    if origin is not None:
        where = owner_repo(origin)
        out = out.when(text.rlike(bare) & where.isNotNull(),
                       make(F.lit("github.com"), where["owner"], where["repo"], get(bare, 1), F.lit("")))
    return out


def set_digest(text) -> Column:
    """An aggregate that names a set of texts in any order: four 60-bit lanes of their SHA-256 are summed, then hashed with the count."""
    full = F.sha2(col(text), 256)
    lanes = [F.sum(F.conv(F.substring(full, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(4)]
    return F.sha2(F.concat_ws(":", *lanes, F.count(F.lit(1)).cast("string")), 256)
