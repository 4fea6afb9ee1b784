"""Note ownership (O1-O12): who created, published or first saved a note.

The reference answers these with one ROW_NUMBER window and one NOT IN per
question. Here every per-note question is one conditional aggregate over the
event log grouped by ``note_id``: a single shuffle whose map side collapses each
note to one row per partition, so a note with a huge number of events never
lands whole in one task. For one author the aggregate only sees the notes the
author touched in the period (``author_candidates``), and ``AuthorScope`` keeps
that result for every author operator. ``first save`` is ``min(struct(ts, ...))`` restricted
to the SAVE rows of the scope (all time, in period, in period with url); ties
on the timestamp go to the smaller editor, NULL editor last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswork.params import CREATE, FIRST_PUBLISH, SAVE, Period

NOTE = "note_id"
EDITOR = "email_editor"
URL = "story_url"
ACTION = "action_type"
TS = "event_timestamp"


def _is(action: str) -> Column:
    return F.col(ACTION) == F.lit(action)


def _first(cond: Column, with_url: bool = True) -> Column:
    """The first row (by time, then editor with NULL last, then url with NULL last) among
    the rows meeting ``cond``, as a struct; the url is carried only when it is needed."""
    fields = [F.col(TS).alias("ts"), F.col(EDITOR).isNull().alias("editor_missing"), F.col(EDITOR).alias("editor")]
    if with_url:
        fields += [F.col(URL).isNull().alias("url_missing"), F.col(URL).alias("url")]
    return F.min(F.when(cond, F.struct(*fields)))


def note_roles(editorial: DataFrame, period: Period | None = None, author: str | None = None,
               all_time_saves: bool = False) -> DataFrame:
    """One row per note with every ownership fact as a column.

    Columns: ``has_create`` (anyone, all time), ``published_in_period``,
    ``created_by_author``, ``published_by_author`` (in period),
    ``first_save`` / ``first_save_url`` (first SAVE in period, the second among
    SAVEs with a url) and ``first_save_ever`` (all time) as structs with
    ``editor`` (and ``url``). Unused columns are pruned by Catalyst.
    """
    in_period = period.covers(TS) if period is not None else F.lit(False)
    relevant = F.col(ACTION).isin(CREATE, FIRST_PUBLISH)
    relevant = relevant | (_is(SAVE) if (all_time_saves or period is None) else (_is(SAVE) & in_period))
    by_author = (F.col(EDITOR) == F.lit(author)) if author is not None else F.lit(False)
    ev = editorial.select(NOTE, EDITOR, URL, ACTION, TS).filter(relevant)
    if author is not None and period is not None:
        # Only notes the author touched in the period can be the author's: restrict the
        # aggregate to them (exact). No size hint: AQE broadcasts the candidate set when
        # its measured size is small and keeps the shuffle join when it is not.
        ev = ev.join(author_candidates(editorial, period, author), NOTE, "left_semi")
    return ev.groupBy(NOTE).agg(
        F.bool_or(_is(CREATE)).alias("has_create"),
        F.bool_or(_is(FIRST_PUBLISH) & in_period).alias("published_in_period"),
        F.bool_or(_is(CREATE) & in_period & by_author).alias("created_by_author"),
        F.bool_or(_is(FIRST_PUBLISH) & in_period & by_author).alias("published_by_author"),
        _first(_is(SAVE) & in_period).alias("first_save"),
        _first(_is(SAVE) & in_period & F.col(URL).isNotNull()).alias("first_save_url"),
        _first(_is(SAVE), with_url=False).alias("first_save_ever"),
    )


def author_candidates(editorial: DataFrame, period: Period, author: str) -> DataFrame:
    """Notes on which the author did a CREATE, FIRST_PUBLISH or SAVE in the period."""
    return (
        editorial.filter((F.col(EDITOR) == F.lit(author)) & F.col(ACTION).isin(CREATE, FIRST_PUBLISH, SAVE) & period.covers(TS))
        .select(NOTE)
        .distinct()
    )


def _first_saved_by(author: str, which: str = "first_save") -> Column:
    return (~F.col("has_create")) & (F.col(which + ".editor") == F.lit(author))


def _author_rows(editorial: DataFrame, period: Period, author: str, actions, require_url: bool) -> DataFrame:
    cond = (F.col(EDITOR) == F.lit(author)) & F.col(ACTION).isin(*actions) & period.covers(TS)
    if require_url:
        cond = cond & F.col(URL).isNotNull()
    return editorial.filter(cond)


# O1
def notes_created_by(editorial: DataFrame, period: Period, author: str, with_url: bool = False) -> DataFrame:
    cols = [NOTE, URL] if with_url else [NOTE]
    return _author_rows(editorial, period, author, [CREATE], with_url).select(*cols).distinct()


# O2
def notes_published_by(editorial: DataFrame, period: Period, author: str, with_url: bool = False) -> DataFrame:
    cols = [NOTE, URL] if with_url else [NOTE]
    return _author_rows(editorial, period, author, [FIRST_PUBLISH], with_url).select(*cols).distinct()


# O3
def first_saves_in_period(editorial: DataFrame, period: Period, require_url: bool = False) -> DataFrame:
    """The first SAVE of each note inside the period (period applied before ranking)."""
    cond = _is(SAVE) & period.covers(TS)
    if require_url:
        cond = cond & F.col(URL).isNotNull()
    first = editorial.filter(cond).groupBy(NOTE).agg(_first(F.lit(True)).alias("fs"))
    cols = [F.col(NOTE), F.col("fs.editor").alias(EDITOR)]
    if require_url:
        cols.append(F.col("fs.url").alias(URL))
    return first.select(*cols)


# O4
def notes_with_create(editorial: DataFrame) -> DataFrame:
    return editorial.filter(_is(CREATE)).select(NOTE).distinct()


# O5
def notes_first_saved_by(editorial: DataFrame, period: Period, author: str, with_url: bool = False) -> DataFrame:
    roles = scope_for(editorial, period, author).roles
    which = "first_save_url" if with_url else "first_save"
    out = roles.filter(_first_saved_by(author, which))
    if with_url:
        return out.select(NOTE, F.col(which + ".url").alias(URL))
    return out.select(NOTE)


def _owned(author: str) -> Column:
    return F.col("created_by_author") | F.col("published_by_author") | F.coalesce(_first_saved_by(author), F.lit(False))


# O6
def author_notes(editorial: DataFrame, period: Period, author: str) -> DataFrame:
    return scope_for(editorial, period, author).notes


# O7
def author_note_urls(editorial: DataFrame, period: Period, author: str, require_url: bool = True,
                     published_only: bool = False) -> DataFrame:
    """(note_id, story_url) pairs of the author's notes.

    ``require_url`` drops NULL urls before the first SAVE is ranked (the usual
    form); with False the first SAVE is ranked over all SAVEs and keeps its url
    (the section form). ``published_only`` keeps notes FIRST_PUBLISHed in the period.
    """
    return scope_for(editorial, period, author).url_pairs(require_url, published_only)


# O8
def notes_published_in_period(editorial: DataFrame, period: Period) -> DataFrame:
    return editorial.filter(_is(FIRST_PUBLISH) & period.covers(TS)).select(NOTE).distinct()


# O9
def author_published_notes(editorial: DataFrame, period: Period, author: str) -> DataFrame:
    return scope_for(editorial, period, author).published_notes


# O10
def author_published_urls(editorial: DataFrame, period: Period, author: str) -> DataFrame:
    return scope_for(editorial, period, author).published_urls


# O11
def real_creators(editorial: DataFrame) -> DataFrame:
    """Every CREATE row, plus the first SAVE (all time) of notes nobody created (UNION ALL)."""
    facts = (
        editorial.select(NOTE, EDITOR, URL, ACTION, TS).filter(F.col(ACTION).isin(CREATE, SAVE))
        .groupBy(NOTE).agg(F.bool_or(_is(CREATE)).alias("has_create"),
                          _first(_is(SAVE), with_url=False).alias("first_save_ever"))
    )
    return real_creators_from_roles(editorial, facts)


# O12
def urls_of_author_notes(editorial: DataFrame, period: Period, author: str) -> DataFrame:
    return scope_for(editorial, period, author).note_urls_any()


def real_creators_from_roles(editorial: DataFrame, roles: DataFrame) -> DataFrame:
    """O11 when a ``note_roles(..., all_time_saves=True)`` frame is already at hand."""
    creates = editorial.filter(_is(CREATE)).select(NOTE, F.col(EDITOR).alias("creator_email"))
    saves = roles.filter(~F.col("has_create") & F.col("first_save_ever").isNotNull()).select(
        NOTE, F.col("first_save_ever.editor").alias("creator_email")
    )
    return creates.unionByName(saves)


def owned_notes(roles: DataFrame, author: str, published: bool = False) -> DataFrame:
    """O6 (or O9 with ``published``) from a ``note_roles`` frame."""
    cond = _owned(author)
    if published:
        cond = cond & F.col("published_in_period")
    return roles.filter(cond).select(NOTE)


class AuthorScope:
    """Ownership of one author in one period, built once and shared by every author operator.

    ``roles`` holds only the author's candidate notes (see ``author_candidates``) and
    is persisted (memory, spilling to disk; recomputed from lineage if an executor
    is lost). Plans of author operators then read it instead of re-deriving
    ownership in every branch.
    """

    def __init__(self, editorial: DataFrame, period: Period, author: str, persist: bool = True):
        from pyspark import StorageLevel

        self.editorial, self.period, self.author = editorial, period, author
        roles = note_roles(editorial, period, author, all_time_saves=True)
        self.roles = roles.persist(StorageLevel.MEMORY_AND_DISK) if persist else roles
        self.notes = owned_notes(self.roles, author)                      # O6
        self.published_notes = owned_notes(self.roles, author, True)      # O9
        urls = self.url_pairs(require_url=True, published_only=True).select(URL).distinct()
        self.published_urls = urls.persist(StorageLevel.MEMORY_AND_DISK) if persist else urls  # O10
        self._persisted = [self.roles, self.published_urls] if persist else []

    def url_pairs(self, require_url: bool = True, published_only: bool = False) -> DataFrame:
        """O7 from the shared roles (and the author's own CREATE / FIRST_PUBLISH rows)."""
        which = "first_save_url" if require_url else "first_save"
        direct = _author_rows(self.editorial, self.period, self.author, [CREATE, FIRST_PUBLISH], require_url).select(NOTE, URL)
        saved = self.roles.filter(_first_saved_by(self.author, which)).select(
            NOTE, F.col(which + ".url").alias(URL))
        pairs = direct.unionByName(saved).distinct()
        if published_only:
            pairs = pairs.join(self.roles.filter("published_in_period").select(NOTE), NOTE, "left_semi")
        return pairs

    def real_creators(self) -> DataFrame:
        """O11 for the author's notes only."""
        return real_creators_from_roles(self.editorial, self.roles).join(self.notes, NOTE, "left_semi")

    def note_urls_any(self) -> DataFrame:
        """Every (note, url) the author's published notes ever had."""
        return (
            self.editorial.filter(F.col(URL).isNotNull()).select(NOTE, URL)
            .join(self.published_notes, NOTE, "left_semi").distinct()
        )

    def unpersist(self) -> None:
        for df in self._persisted:
            try:
                df.unpersist()
            except Exception:  # the session is already stopped: nothing is cached any more
                pass


_SCOPES: "dict[tuple, AuthorScope]" = {}
_SCOPE_LIMIT = 8


def scope_for(editorial: DataFrame, period: Period, author: str) -> AuthorScope:
    """The shared scope of (editorial, period, author); a small LRU, the oldest is unpersisted."""
    key = (id(editorial), period, author)
    scope = _SCOPES.pop(key, None)
    if scope is None:
        scope = AuthorScope(editorial, period, author)
        while len(_SCOPES) >= _SCOPE_LIMIT:
            _SCOPES.pop(next(iter(_SCOPES))).unpersist()
    _SCOPES[key] = scope
    return scope


def clear_scopes(editorial: DataFrame | None = None) -> None:
    """Unpersist every shared author scope, or those of one event log."""
    for key in [k for k, scope in _SCOPES.items() if editorial is None or scope.editorial is editorial]:
        _SCOPES.pop(key).unpersist()
