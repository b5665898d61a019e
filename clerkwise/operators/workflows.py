"""Workflow rules as joins.

A pass judges every action on the same document snapshot; the writes of the
pass are merged afterwards, the later write of a column winning.
"""

from __future__ import annotations

import json
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clerkwise.functions.codec import truthy
from clerkwise.functions.once import compute_once
from clerkwise.functions.predicates import TO_ASSIGN, transition_allowed
from clerkwise.functions.rendering import event_context, letter_context, recipient, render
from clerkwise.functions.text import strip
from clerkwise.session import BROADCAST_MAX_ROWS, broadcast_if_small

# Fields a rule may filter on.
FILTER_FIELDS = ("doc_type", "department", "status", "urgency", "source_channel")

GLOBAL = "*global*"
ANY = "*any*"

_TEXTS = ("name", "filters_json", "actions_json")
_ACTIONS = "array<struct<type:string,config:map<string,string>>>"


def parse_rules(rules: DataFrame) -> DataFrame:
    """Scoped rule rows with typed filters and actions. Malformed JSON means no
    filter and no action."""
    v = F.try_parse_json("filters_json")
    parsed = compute_once(rules, {"__v": v})
    f = F.col("__v")
    out = {}
    for name in FILTER_FIELDS:
        text = F.try_variant_get(f, f"$.{name}", "string")
        several = F.try_variant_get(f, f"$.{name}", "array<string>")
        out[f"want_{name}"] = F.coalesce(several, F.when(text != "", F.array(text)))
    for bound in ("min_confidence", "max_confidence"):
        given = F.try_variant_get(f, f"$.{bound}", "string").isNotNull()
        number = F.try_variant_get(f, f"$.{bound}", "double")
        out[f"want_{bound}"] = number
        out[f"bad_{bound}"] = F.coalesce(given & number.isNull(), F.lit(False))
    name = F.coalesce(F.nullif("name", F.lit("")), F.concat(F.lit("workflow-"), F.col("id").cast("string")))
    actions = F.coalesce(F.from_json("actions_json", _ACTIONS), F.array().cast(_ACTIONS))
    parsed = parsed.withColumns(out)
    kept = ["trigger_event"] if "trigger_event" in rules.columns else []
    return parsed.select("scope", *kept, F.col("id").alias("rule_id"), name.alias("rule_name"), *out, actions.alias("actions"))


def live_rules(rules: DataFrame, trigger: str | None) -> DataFrame:
    """Enabled rules, of one trigger or of all, under the scope they are read in: a workspace or the global one."""
    live = rules.filter("enabled").select("id", "workspace_id", "trigger_event", *_TEXTS)
    if trigger is not None:
        live = live.filter(F.col("trigger_event") == trigger)
    return live.withColumn("scope", F.coalesce("workspace_id", F.lit(GLOBAL))).drop("workspace_id")


# Entries of one rule in the index, at most; filters that would make more are checked after the lookup.
MOST_ENTRIES = 64
INDEXED = (*FILTER_FIELDS, "confidence")


def _tenth(score: Column) -> Column:
    """Tenth of a confidence, 0 to 10, as text. It never falls as the score grows; what is not a number counts as the greatest."""
    return F.when(score.isNotNull(), F.floor(F.least(F.greatest(score * 10, F.lit(0.0)), F.lit(10.0))).cast("string"))


def index_rules(parsed: DataFrame, most: int = MOST_ENTRIES) -> DataFrame:
    """One row for each entry of each rule: ``shape`` says which filters the entry spells out, ``key_*`` with which values.

    A rule is entered once for every combination of the values that its filters allow, a bound on the confidence counting as the tenths it covers. A
    document that it matches has exactly one of them. A rule that allows no value has no entry.
    """
    low, high = F.col("want_min_confidence"), F.col("want_max_confidence")
    tenths = F.sequence(F.coalesce(_tenth(low), F.lit("0")).cast("int"), F.coalesce(_tenth(high), F.lit("10")).cast("int"))
    allowed = {name: F.array_distinct(F.filter(f"want_{name}", lambda v: v.isNotNull())) for name in FILTER_FIELDS}
    allowed["confidence"] = F.when(low.isNotNull() | high.isNotNull(), F.transform(tenths, lambda t: t.cast("string")))
    out = compute_once(parsed, {f"__all_{name}": values for name, values in allowed.items()} | {"__n": F.lit(1).cast("long")})
    for name in INDEXED:
        values = F.col(f"__all_{name}")
        more = F.col("__n") * F.size(values)
        taken = F.coalesce(more <= most, F.lit(False))
        out = compute_once(out, {f"__all_{name}": F.when(taken, values), "__n": F.when(taken, more).otherwise(F.col("__n"))})
    shape = F.concat(*[F.when(F.col(f"__all_{name}").isNull(), "0").otherwise("1") for name in INDEXED])
    out = out.withColumn("shape", shape)
    for name in INDEXED:
        out = out.withColumn(f"key_{name}", F.explode(F.coalesce(f"__all_{name}", F.array(F.lit("")))))
    return out.drop("__n", *[f"__all_{name}" for name in INDEXED])


def _lookups(shapes: list[str]) -> Column:
    """The index entries in which a document may find rules: one for each shape in use."""
    own = [F.coalesce(F.col(name), F.lit("")) for name in FILTER_FIELDS] + [_tenth(F.coalesce(F.col("confidence"), F.lit(0.0)))]
    return F.array(*[
        F.struct(F.lit(shape).alias("shape"), *[(value if bit == "1" else F.lit("")).alias(f"key_{name}") for name, bit, value in zip(INDEXED, shape, own, strict=True)])
        for shape in shapes])


def first_rules(live: DataFrame, limit: int) -> DataFrame:
    """Only the first ``limit`` rules by id that a workspace sees, its own and the global ones together."""
    own, shared = live.filter(F.col("scope") != GLOBAL), live.filter(F.col("scope") == GLOBAL).orderBy("id").limit(limit)
    # At most ``limit`` global rules are looked at for each workspace.
    seen = own.unionByName(shared.drop("scope").join(own.select("scope").distinct(), F.lit(True)).select(*own.columns))
    rank = F.row_number().over(W.partitionBy("scope").orderBy("id"))
    return seen.withColumn("__rank", rank).filter(F.col("__rank") <= limit).drop("__rank").unionByName(shared)


def index_actions(indexed: DataFrame) -> DataFrame:
    """One row for each action of each entry, with the filters that the entry has not decided; what it takes to name an action is done here
    and not for every pair. Rules with a bound that is no number match nothing."""
    left = {f"want_{name}": F.when(F.substring("shape", place, 1) == "0", F.col(f"want_{name}")) for place, name in enumerate(FILTER_FIELDS, 1)}
    rows = indexed.filter("not bad_min_confidence and not bad_max_confidence").withColumns(left)
    kept = [c for c in rows.columns if c not in ("actions", "bad_min_confidence", "bad_max_confidence")]
    rows = rows.select(*kept, F.posexplode("actions").alias("pos", "action"))
    nothing = F.from_json(F.lit("{}"), "map<string,string>")
    return rows.select(
        *kept, "pos", F.lower(strip(F.coalesce(F.col("action.type"), F.lit("")))).alias("action_type"),
        F.coalesce(F.col("action.config"), nothing).alias("config"))


def _matches() -> Column:
    """What the lookup has not decided."""
    cond = F.lit(True)
    for name in FILTER_FIELDS:
        want = F.col(f"want_{name}")
        cond = cond & (want.isNull() | F.array_contains(want, F.coalesce(F.col(name), F.lit(""))))
    score = F.coalesce(F.col("confidence"), F.lit(0.0))
    low, high = F.col("want_min_confidence"), F.col("want_max_confidence")
    return cond & (low.isNull() | (score >= low)) & (high.isNull() | (score <= high))


def status_trigger() -> Column:
    """The trigger of the pass that follows a document's processing: document_<status>."""
    return F.concat(F.lit("document_"), F.lower(strip(F.col("status"))))


def matched_actions(docs: DataFrame, rules: DataFrame, trigger: str | None, keep: list[str],
                    limit: int | None = None, small: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """One row per document, matching rule and action, with the ``keep`` columns
    of the document. All rules apply; ``limit`` bounds those a workspace sees, if given. Without a ``trigger`` each
    document has that of its status.

    ``rules`` are raw rule rows. They are read through an index (``index_rules``): a document looks up one entry for each
    scope, its workspace and the global one, and each shape of filters in use (at most 64, a handful in practice), so what is compared
    stays near what matches, however many rules there are. The join is an equi join on scope, shape and values. The index is
    broadcast when it is measured to be small (at most ``small`` rows, and bounded in bytes); otherwise both
    sides shuffle on the entry and AQE splits a hot one.
    """
    live = live_rules(rules, trigger)
    needed = list(dict.fromkeys([*keep, "id", "workspace_id", "confidence", *FILTER_FIELDS]))
    if limit is None:
        scopes = F.array_compact(F.array(F.col("workspace_id"), F.lit(GLOBAL)))
        placed = docs.select(*needed, F.explode(scopes).alias("__scope"))
    else:
        live = first_rules(live, limit)
        owners = live.select(F.col("scope").alias("__scope")).filter(F.col("__scope") != GLOBAL).distinct()
        placed = docs.select(*needed).join(broadcast_if_small(owners), F.col("workspace_id") == F.col("__scope"), "left").withColumn(
            "__scope", F.coalesce("__scope", F.lit(GLOBAL)))
    indexed = index_actions(index_rules(parse_rules(live)))
    # At most one for each set of filters.
    shapes = sorted(r["shape"] for r in indexed.select("shape").distinct().collect()) or ["0" * len(INDEXED)]
    placed = placed.withColumn("__at", F.explode(_lookups(shapes)))
    own = F.col("__scope") == F.col("scope")
    for name in ("shape", *[f"key_{name}" for name in INDEXED]):
        own = own & (F.col(f"__at.{name}") == F.col(name))
    if trigger is None:
        own = own & (status_trigger() == F.col("trigger_event"))
    pairs = placed.join(broadcast_if_small(indexed, small), own & _matches(), "inner")
    return pairs.select(*keep, F.col("id").alias("document_id"), "rule_id", "rule_name", "pos", "action_type", "config")


def match_workflows(docs: DataFrame, rules: DataFrame, trigger: str,
                    limit: int | None = None) -> DataFrame:
    """(document_id, rule_id, rule_name, pos, action_type, config) of one pass."""
    return matched_actions(docs, rules, trigger, [], limit)


class WorkflowEffects:
    """Effects of one pass, each a DataFrame built when it is asked for.

    ``acted`` comes from ``matched_actions`` with the document columns kept, so the documents are not joined again, and every
    effect reads it once: an action has at most one effect, whose columns stand in its own row (``effect_rows``). ``stored`` writes these
    rows, with the columns that effects are made of, and reads all effects from there, for when more than one is wanted.
    """

    def __init__(self, acted: DataFrame, rules: DataFrame, templates: DataFrame, workspaces: DataFrame, trigger: str | None,
                 as_of: Column, actor: str = "system", kept: DataFrame | None = None):
        self.acted, self.rules, self.templates, self.workspaces = acted, rules, templates, workspaces
        self.given, self.as_of, self.actor, self.kept = trigger, as_of, actor, kept
        self.trigger = status_trigger() if trigger is None else F.lit(trigger)

    def rows(self, *kinds: str, without: tuple[str, ...] = ()) -> DataFrame:
        """Actions of some kinds that took effect, with the columns of their effects."""
        if self.kept is not None:
            return self.kept.filter(F.col("action_type").isin(*kinds))
        offers = mail_offers(self.rules, self.templates, self.given) if "send_template_email" in kinds else None
        return effect_rows(self.acted, kinds, offers, self.workspaces, self.trigger, self.actor, self.as_of, without)

    def stored(self, path: str) -> WorkflowEffects:
        """The same effects, all read from one table at ``path`` that is written now; it replaces one that is there."""
        made = self.rows(*EFFECTS).select(*STORED)
        made.write.mode("overwrite").parquet(path)
        kept = made.sparkSession.read.schema(made.schema).parquet(path)
        return WorkflowEffects(self.acted, self.rules, self.templates, self.workspaces, self.given, self.as_of, self.actor, kept)

    @cached_property
    def documents(self) -> DataFrame:
        if self.kept is None:
            return changed_documents(self.acted, self.workspaces)
        rows = self.rows("assign", "transition")
        return _last_writes(rows.select("document_id", "rule_id", "pos", F.col("new_assignee").alias("w_assigned_to"), F.col("new_status").alias("w_status"),
                                        F.col("new_notes").alias("w_reviewer_notes")))

    @cached_property
    def audit(self) -> DataFrame:
        def say(**named: str) -> Column:
            return F.concat(*[part for key, name in named.items() for part in (F.lit(f" {key}="), F.col(name).cast("string"))])

        event = F.concat(F.lit(" event="), self.trigger)
        kind = F.col("action_type")
        said = {
            "assign": ("workflow_assigned", say(assigned_to="new_assignee")),
            "transition": ("workflow_transition", F.concat(say(**{"from": "from_status"}), say(to="new_status"))),
            "create_notification": ("workflow_notification_created", F.concat(event, say(type="type"))),
            "send_template_email": ("workflow_email_queued", say(to="to_email", template_id="template_id")),
            "webhook_post": ("workflow_webhook_queued", F.concat(event, say(url="url"))),
        }
        rows = self.rows(*EFFECTS, without=("title", "message", "subject", "payload"))
        action = reduce(lambda col, k: col.when(kind == k, said[k][0]), said, F)
        details = reduce(lambda col, k: col.when(kind == k, said[k][1]), said, F)
        return rows.select("document_id", "workspace_id", "rule_id", "pos", action.alias("action"), F.lit(self.actor).alias("actor"),
                           F.concat(F.lit("rule="), F.col("rule_name"), details).alias("details"), self.as_of.alias("created_at"))

    @cached_property
    def notifications(self) -> DataFrame:
        kind, by_rule = F.col("action_type"), F.concat(F.lit("Rule: "), F.col("rule_name"))
        name = F.coalesce("filename", F.lit("None"))
        moved = F.concat(name, F.lit(": "), F.col("from_status"), F.lit(" -> "), F.col("new_status"))
        assigned, told = kind == "assign", kind == "create_notification"
        return self.rows("assign", "transition", "create_notification").select(
            "document_id", "workspace_id", "rule_id", "pos", F.when(assigned, F.col("new_assignee")).when(told, F.col("user_id")).alias("user_id"),
            F.when(assigned, "assignment").when(told, F.col("type")).otherwise("status_change").alias("type"),
            F.when(assigned, F.concat(F.lit("Assigned by workflow: "), name)).when(told, F.col("title")).otherwise(moved).alias("title"),
            F.when(told, F.col("message")).otherwise(by_rule).alias("message"), F.lit(False).alias("is_read"), self.as_of.alias("created_at"))

    @cached_property
    def outbox(self) -> DataFrame:
        return self.rows("send_template_email").select("document_id", "workspace_id", "rule_id", "pos", "to_email", "subject", "body",
                                                       F.lit("pending").alias("status"), self.as_of.alias("created_at"))

    @cached_property
    def webhooks(self) -> DataFrame:
        return self.rows("webhook_post").select("document_id", "workspace_id", "rule_id", "pos", "url", "payload")


# Kinds of action that have an effect, and the columns that an effect of the kind fills.
EFFECTS = {
    "assign": ("new_assignee", "new_status"),
    "transition": ("from_status", "new_status", "new_notes"),
    "create_notification": ("title", "message", "type", "user_id"),
    "send_template_email": ("template_id", "to_email", "subject", "body"),
    "webhook_post": ("url", "payload"),
}

# What effects read of an action and its document, and the columns of the effects.
STORED = ("document_id", "workspace_id", "rule_id", "rule_name", "pos", "action_type", "filename", "status",
          *dict.fromkeys(c for own in EFFECTS.values() for c in own))


def effect_rows(acted: DataFrame, kinds: tuple[str, ...], offers: DataFrame | None, workspaces: DataFrame, trigger: Column, actor: str, as_of: Column,
                without: tuple[str, ...] = ()) -> DataFrame:
    """The actions of some kinds that take effect, each with the columns of its own effect; those of other kinds are null.

    One pass over ``acted``. Owners are joined for assignments and ``offers`` (see ``mail_offers``) for mails only. Columns named in
    ``without`` are not made.
    """
    kind = F.col("action_type")
    rows = acted.filter(kind.isin(*kinds))
    made: dict[str, dict[str, Column]] = {}
    if "assign" in kinds:
        rows = _with_owner(rows, workspaces)
        made["assign"] = _assignment()
    if "transition" in kinds:
        made["transition"] = _transition()
    if "create_notification" in kinds:
        made["create_notification"] = _notice(trigger)
    if "send_template_email" in kinds:
        rows = with_template(rows.withColumn("__wish", F.when(kind == "send_template_email", _wish(F.col("config")))), offers)
        made["send_template_email"] = {"template_id": F.col("template_id")} | letter()
    if "webhook_post" in kinds:
        made["webhook_post"] = {"url": F.nullif(_option("url"), F.lit("")), "payload": _payload(trigger, actor, as_of)}
    columns = {}
    for name in dict.fromkeys(c for k in kinds for c in EFFECTS[k] if c not in without):
        own = [(k, made[k][name]) for k in kinds if name in made[k]]
        columns[name] = reduce(lambda col, one: col.when(kind == one[0], one[1]), own, F)
    rows = compute_once(rows, columns, apart=True).drop("__ws", "__owner", "template_name", "template_body")
    takes = {"assign": "new_assignee is not null", "transition": "new_status is not null", "create_notification": "true",
             "send_template_email": "to_email is not null and body <> ''", "webhook_post": "url is not null"}
    return rows.filter(" or ".join(f"(action_type = '{k}' and {takes[k]})" for k in kinds))


def _option(key: str) -> Column:
    return strip(F.coalesce(F.try_element_at(F.col("config"), F.lit(key)), F.lit("")))


def _with_owner(acted: DataFrame, workspaces: DataFrame) -> DataFrame:
    owners = workspaces.select(F.col("id").alias("__ws"), F.col("owner_id").alias("__owner"))
    return acted.join(owners, F.col("workspace_id") == F.col("__ws"), "left")


def _assignment() -> dict[str, Column]:
    """new_assignee of an assignment that takes effect, and its new_status."""
    owner = F.when(F.lower(_option("assignee")) == "workspace_owner", F.nullif("__owner", F.lit("")))
    assignee = F.coalesce(F.nullif(_option("user_id"), F.lit("")), owner)
    taken = F.coalesce(strip(F.col("assigned_to")), F.lit("")) != ""
    go = ~(truthy(F.col("config"), "only_if_unassigned", True) & taken) & assignee.isNotNull()
    to_assigned = truthy(F.col("config"), "set_status_assigned", True) & F.lower(strip(F.col("status"))).isin(*TO_ASSIGN)
    return {"new_assignee": F.when(go, assignee), "new_status": F.when(go & to_assigned, F.lit("assigned"))}


def _transition() -> dict[str, Column]:
    """new_status of a transition along an allowed edge, and its new_notes."""
    status = F.nullif(F.coalesce(F.try_element_at(F.col("config"), F.lit("status")), F.lit("")), F.lit(""))
    target = F.lower(strip(F.coalesce(status, F.try_element_at(F.col("config"), F.lit("to_status")), F.lit(""))))
    current = F.lower(strip(F.coalesce("status", F.lit(""))))
    go = transition_allowed(current, target)
    return {"from_status": current, "new_status": F.when(go, target),
            "new_notes": F.when(go, F.nullif(_option("notes"), F.lit("")))}


def changed_documents(acted: DataFrame, workspaces: DataFrame) -> DataFrame:
    """Per document the last written value of each column; null = not written.

    Both kinds of write come from one pass over the actions.
    """
    rows = _with_owner(acted.filter("action_type in ('assign', 'transition')"), workspaces)
    assigning = F.col("action_type") == "assign"
    assign, move = _assignment(), _transition()
    writes = compute_once(rows.select("document_id", "rule_id", "pos", "action_type", "assigned_to", "status", "config", "__owner"), {
        "w_assigned_to": F.when(assigning, assign["new_assignee"]),
        "w_status": F.when(assigning, assign["new_status"]).otherwise(move["new_status"]),
        "w_reviewer_notes": F.when(~assigning, move["new_notes"]),
    }).filter("w_assigned_to is not null or w_status is not null")
    return _last_writes(writes)


def _last_writes(writes: DataFrame) -> DataFrame:
    at = F.struct("rule_id", "pos")
    return writes.groupBy("document_id").agg(*[
        F.max_by(f"w_{c}", F.when(F.col(f"w_{c}").isNotNull(), at)).alias(c)
        for c in ("assigned_to", "status", "reviewer_notes")])


def _notice(trigger: Column) -> dict[str, Column]:
    context, fields = event_context(), F.col("extracted_fields")
    raw_title = F.nullif(F.coalesce(F.try_element_at(F.col("config"), F.lit("title")), F.lit("")), F.lit(""))
    message = F.when(_option("message") != "", render(_option("message"), context, fields))
    return {
        "title": render(strip(F.coalesce(raw_title, F.lit("Workflow event"))), context, fields),
        "message": F.coalesce(message, F.concat(F.lit("Event: "), trigger)),
        "type": F.coalesce(F.nullif(_option("type"), F.lit("")), F.lit("workflow")),
        "user_id": F.nullif(_option("user_id"), F.lit("")),
    }


def _template_scopes(templates: DataFrame) -> DataFrame:
    """Templates under every scope they are visible in: their workspace (or the
    global one) and, for documents without a workspace, everywhere."""
    keys = F.array(F.coalesce("workspace_id", F.lit(GLOBAL)), F.lit(ANY))
    return templates.select(
        F.explode(keys).alias("__tscope"), F.col("id").alias("template_id"), F.col("name").alias("template_name"),
        "template_body")


def _wish(config: Column) -> Column:
    """Which template a mail action asks for: by id, else by a hint that its name contains. Null if by neither."""
    number = F.try_element_at(config, F.lit("template_id"))
    number = F.trim(number).try_cast("long")
    hint = F.lower(strip(F.coalesce(F.try_element_at(config, F.lit("template_name_hint")), F.lit(""))))
    return F.when(number.isNotNull(), F.concat(F.lit("id "), number.cast("string"))).when(hint != "", F.concat(F.lit("hint "), hint))


def hint_wish(hint: str) -> str:
    return f"hint {hint.lower()}"


def mail_offers(rules: DataFrame, templates: DataFrame, trigger: str | None) -> DataFrame:
    """``template_offers`` for all that the mail actions of the live rules ask for."""
    actions = live_rules(rules, trigger).select(F.explode(F.from_json("actions_json", _ACTIONS)).alias("a"))
    mails = actions.filter(F.lower(strip(F.coalesce(F.col("a.type"), F.lit("")))) == "send_template_email")
    return template_offers(mails.select(_wish(F.col("a.config")).alias("wish")).filter("wish is not null").distinct(), templates)


def template_offers(wishes: DataFrame, templates: DataFrame) -> DataFrame:
    """For each wish (text, see ``_wish``) and scope the first template by name, then by id: __offered, __tscope, __t."""
    scoped = _template_scopes(templates)
    by_id = wishes.filter("wish like 'id %'").select("wish", F.substring("wish", 4, 20).cast("long").alias("__id"))
    by_hint = wishes.filter("wish like 'hint %'").select("wish", F.expr("substring(wish, 6)").alias("__hint"))
    found = scoped.join(broadcast_if_small(by_id), F.col("template_id") == F.col("__id")).drop("__id").unionByName(
        scoped.join(broadcast_if_small(by_hint), F.contains(F.lower("template_name"), F.col("__hint"))).drop("__hint"))
    one = F.struct("template_name", "template_id", "template_body")
    return found.groupBy(F.col("wish").alias("__offered"), "__tscope").agg(F.min_by(one, F.struct("template_name", "template_id")).alias("__t"))


def with_template(rows: DataFrame, offers: DataFrame) -> DataFrame:
    """template_id, template_name and template_body for ``__wish``: the first by name of the row's workspace and the global ones, or
    of all for a row without a workspace. Null without one."""
    offers = broadcast_if_small(offers)
    workspace = F.col("workspace_id")
    for number, scope in enumerate((F.coalesce(workspace, F.lit(ANY)), F.when(workspace.isNotNull(), F.lit(GLOBAL)))):
        side = offers.select(*[F.col(c).alias(f"{c}{number}") for c in ("__offered", "__tscope", "__t")])
        rows = rows.join(side, (F.col("__wish") == F.col(f"__offered{number}")) & (scope == F.col(f"__tscope{number}")), "left").drop(
            f"__offered{number}", f"__tscope{number}")
    best = F.least("__t0", "__t1")
    return rows.withColumns({c: best[c] for c in ("template_id", "template_name", "template_body")}).drop("__t0", "__t1", "__wish")


def letter() -> dict[str, Column]:
    """to_email, subject and body from a template row joined to its document; null without a template."""
    filename = strip(F.coalesce("filename", F.lit("None")))
    there = F.col("template_id").isNotNull()
    subject = F.concat(F.col("template_name"), F.lit(" - "), F.coalesce(F.nullif(filename, F.lit("")), F.lit("Update")))
    return {
        "to_email": F.when(there, recipient(F.col("extracted_fields"))),
        "subject": F.when(there, subject),
        "body": F.when(there, render(F.col("template_body"), letter_context(), F.col("extracted_fields"))),
    }


def compose_mail(rows: DataFrame) -> DataFrame:
    """Rows with a template, a recipient and a body, with to_email, subject and body."""
    return compute_once(rows, letter()).filter("to_email is not null and body <> ''")


def _payload(trigger: Column, actor: str, as_of: Column) -> Column:
    """What a webhook will be told later; no call is made."""
    document = F.struct("id", "filename", "status", "doc_type", "department", "urgency",
                        "confidence", "assigned_to", "due_date", "source_channel")
    return F.to_json(F.struct(
        trigger.alias("event"), F.col("rule_name").alias("rule"), F.lit(actor).alias("actor"),
        "workspace_id", document.alias("document"), "extracted_fields",
        "missing_fields", "validation_errors", as_of.alias("sent_at")), {"ignoreNullFields": "false"})


def run_workflows(docs: DataFrame, rules: DataFrame, templates: DataFrame, workspaces: DataFrame,
                  trigger: str | None, as_of: Column, actor: str = "system") -> WorkflowEffects:
    """Effects of one pass; without a ``trigger`` it is the pass of each document's status."""
    acted = matched_actions(docs, rules, trigger, [c for c in docs.columns if c != "extracted_text"])
    return WorkflowEffects(acted, rules, templates, workspaces, trigger, as_of, actor)


def after_pass(docs: DataFrame, effects: WorkflowEffects, as_of: Column) -> DataFrame:
    """Snapshot that the second pass reads: written columns replaced."""
    from clerkwise.operators.changes import update_present

    return update_present(docs, effects.documents.withColumnRenamed("document_id", "id"), "id",
                          ["assigned_to", "status", "reviewer_notes"], as_of)


def run_passes(docs: DataFrame, rules: DataFrame, templates: DataFrame, workspaces: DataFrame, trigger: str,
               as_of: Column) -> tuple[list[WorkflowEffects], DataFrame]:
    """The pass of ``trigger`` and, on the documents as it left them, the pass of their status;
    with the documents after both."""
    first = run_workflows(docs, rules, templates, workspaces, trigger, as_of)
    between = after_pass(docs, first, as_of)
    second = run_workflows(between, rules, templates, workspaces, None, as_of)
    return [first, second], after_pass(between, second, as_of)


# Starter packs. Each entry: pack id, rule name, trigger, filters, actions.
PRESET_RULES = [
    ("gov-intake-triage", "Triage: Auto-assign needs_review", "document_needs_review", {},
     [{"type": "assign", "config": {"assignee": "workspace_owner", "only_if_unassigned": True}}]),
    ("gov-intake-triage", "Triage: Broadcast needs_review alert", "document_needs_review", {},
     [{"type": "create_notification", "config": {
         "type": "triage", "title": "Needs review: {{filename}}",
         "message": "New document requires review. Status: {{status}}. Doc type: {{doc_type}}. Dept: {{department}}."}}]),
    ("gov-foia", "FOIA: Auto-assign on ingestion", "document_ingested", {"doc_type": ["foia_request", "foi_request"]},
     [{"type": "assign", "config": {"assignee": "workspace_owner"}}]),
    ("gov-foia", "FOIA: Notify when overdue", "document_overdue", {"doc_type": ["foia_request", "foi_request"]},
     [{"type": "create_notification", "config": {
         "type": "sla", "title": "FOIA overdue: {{filename}}",
         "message": "FOIA request is overdue. Due: {{due_date}}. Assigned: {{assigned_to}}."}}]),
    ("gov-foia", "FOIA: Email requester on approval", "document_approved", {"doc_type": ["foia_request", "foi_request"]},
     [{"type": "send_template_email", "config": {"template_name_hint": "FOIA Status Update"}}]),
    ("gov-permits", "Permits: Auto-assign on needs_review", "document_needs_review",
     {"doc_type": ["permit_application", "business_license"]},
     [{"type": "assign", "config": {"assignee": "workspace_owner"}}]),
    ("gov-permits", "Permits: Email applicant on approval", "document_approved",
     {"doc_type": ["permit_application", "business_license"]},
     [{"type": "send_template_email", "config": {"template_name_hint": "Permit Decision Notice"}}]),
    ("biz-ap-invoices", "AP: Auto-assign invoices needing review", "document_needs_review",
     {"doc_type": ["invoice", "purchase_order"]},
     [{"type": "assign", "config": {"assignee": "workspace_owner", "only_if_unassigned": True}}]),
    ("biz-ap-invoices", "AP: Notify on high-confidence processed invoices", "document_processed",
     {"doc_type": ["invoice"], "min_confidence": 0.92},
     [{"type": "create_notification", "config": {
         "type": "ap", "title": "Invoice ready: {{filename}}",
         "message": "Invoice processed at confidence {{confidence}}. Review fields and approve if ready."}}]),
    ("biz-contracts", "Contracts: Auto-assign on ingestion", "document_ingested", {"doc_type": ["contract"]},
     [{"type": "assign", "config": {"assignee": "workspace_owner"}}]),
    ("biz-contracts", "Contracts: Notify when overdue", "document_overdue", {"doc_type": ["contract"]},
     [{"type": "create_notification", "config": {
         "type": "sla", "title": "Contract overdue: {{filename}}",
         "message": "Contract is overdue. Due: {{due_date}}. Assigned: {{assigned_to}}."}}]),
]

# Letter templates of the starter packs (pack id, name, doc_type, body).
PRESET_TEMPLATES = [
    ("gov-foia", "FOIA Status Update", "foia_request",
     "Hello {{applicant_name}},\n\nWe have an update on your public records request.\n\n"
     "Document: {{filename}}\nCurrent status: {{status}}\nReference: {{id}}\n\nThank you,\nCity Records Office\n"),
    ("gov-permits", "Permit Decision Notice", "permit_application",
     "Hello {{applicant_name}},\n\nYour permit application has been updated.\n\n"
     "Document: {{filename}}\nStatus: {{status}}\nReference: {{id}}\n\nThank you,\nPermitting Office\n"),
]


def preset_rules(spark) -> DataFrame:
    rows = [(pack, name, trigger, json.dumps(filters), json.dumps(actions))
            for pack, name, trigger, filters, actions in PRESET_RULES]
    return spark.createDataFrame(
        rows, "preset_id string, name string, trigger_event string, filters_json string, actions_json string")


def preset_templates(spark) -> DataFrame:
    return spark.createDataFrame(
        PRESET_TEMPLATES, "preset_id string, name string, doc_type string, template_body string")


def missing_presets(presets: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Preset rows not there yet, by lower-cased keys; nothing is overwritten."""
    have = existing.select(*[F.lower(strip(F.col(k))).alias(f"__{k}") for k in keys]).distinct()
    on = F.lit(True)
    for k in keys:
        on = on & (F.lower(strip(F.col(k))) == F.col(f"__{k}"))
    return presets.join(have, on, "left_anti")


def _catalogue(presets: DataFrame) -> DataFrame:
    """Catalogue rows by pack: eleven rules or two templates, a fixed list."""
    return F.broadcast(presets.withColumnRenamed("preset_id", "__pack"))


def apply_presets(chosen: DataFrame, rules: DataFrame, templates: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Starter packs for many workspaces at once: ``chosen`` (workspace_id, preset_id), one row for each pack of each workspace.

    New rule rows, new template rows, and for each workspace, pack and kind how many are created and skipped. A rule is skipped if the workspace has one of
    its name and trigger, a template if the workspace or everybody has one of its name (both without regard to case and blanks around it). Names
    that two packs share are created once, for the pack that comes first. One equi join on the pack and one anti-join for each kind.
    """
    spark = rules.sparkSession
    chosen = chosen.select("workspace_id", "preset_id").distinct()
    wanted_rules = chosen.join(_catalogue(preset_rules(spark)), F.col("preset_id") == F.col("__pack")).drop("__pack")
    wanted_templates = chosen.join(_catalogue(preset_templates(spark)), F.col("preset_id") == F.col("__pack")).drop("__pack")

    def plain(name: str) -> Column:
        return F.lower(strip(F.col(name)))

    def once(rows: DataFrame, *keys: str) -> DataFrame:
        rank = F.row_number().over(W.partitionBy("workspace_id", *[plain(k) for k in keys]).orderBy("preset_id"))
        return rows.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")

    # A catalogue has few names, so only rows of these names can be in the way.
    own = rules.select(F.col("workspace_id").alias("__ws"), plain("name").alias("__name"), plain("trigger_event").alias("__event"))
    new_rules = once(wanted_rules, "name", "trigger_event").join(
        own, (F.col("workspace_id") == F.col("__ws")) & (plain("name") == F.col("__name")) & (plain("trigger_event") == F.col("__event")), "left_anti")
    known = templates.select(F.col("workspace_id").alias("__ws"), plain("name").alias("__name"))
    everywhere = F.broadcast(known.filter("__ws is null").select("__name").distinct().join(
        _catalogue(preset_templates(spark)), F.col("__name") == plain("name"), "left_semi"))
    new_templates = once(wanted_templates, "name").join(
        known, (F.col("workspace_id") == F.col("__ws")) & (plain("name") == F.col("__name")), "left_anti").join(
        everywhere, plain("name") == F.col("__name"), "left_anti")

    def tally(kind: str, wanted: DataFrame, created: DataFrame) -> DataFrame:
        rows = wanted.select("workspace_id", "preset_id", F.lit(0).alias("c"), F.lit(1).alias("w")).unionByName(
            created.select("workspace_id", "preset_id", F.lit(1).alias("c"), F.lit(0).alias("w")))
        return rows.groupBy("workspace_id", "preset_id").agg(F.sum("c").alias("created"), (F.sum("w") - F.sum("c")).alias("skipped")).withColumn("kind", F.lit(kind))

    made = tally("rules", wanted_rules, new_rules).unionByName(tally("templates", wanted_templates, new_templates))
    kinds = F.explode(F.array(F.lit("rules"), F.lit("templates")))
    counts = (chosen.withColumn("kind", kinds).join(made, ["workspace_id", "preset_id", "kind"], "left")
              .select("workspace_id", "preset_id", "kind", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("created", "skipped")]))
    return (new_rules.select("workspace_id", "name", F.lit(True).alias("enabled"), "trigger_event", "filters_json", "actions_json"),
            new_templates.select("workspace_id", "name", "doc_type", "template_body"), counts)


def apply_preset(preset_id: str, workspace_id: str, rules: DataFrame, templates: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``apply_presets`` for one pack and workspace; the counts are those of the kinds."""
    chosen = rules.sparkSession.range(1).select(F.lit(workspace_id).alias("workspace_id"), F.lit(preset_id).alias("preset_id"))
    new_rules, new_templates, counts = apply_presets(chosen, rules, templates)
    return new_rules, new_templates, counts.select("kind", "created", "skipped")
