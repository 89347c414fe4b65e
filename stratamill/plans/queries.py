"""Queries over the supplied tables in the shapes of the record operators, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratamill.functions import decisions as d
from stratamill.functions import scalars as s
from stratamill.operators import blocks, choose, normalize, waiting
from stratamill.sources import pages, settings, stored


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


INF = float("inf")


def _types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as a catalog of types: sizes stand for the memory, prices for the processors, part types for the
    architecture, brands for the regions."""
    part = _t(spark, sf_dir, "part")
    return part.select(
        F.col("p_partkey").alias("id"), F.col("p_partkey").cast("string").alias("name"), F.col("p_retailprice").alias("vcpu"), F.col("p_size").cast("double").alias("memory_gb"), F.lit(0.0).alias("disk_gb"),
        F.col("p_type").alias("arch"), F.array("p_brand").alias("available_regions"), "p_size",
    )


def _parts(types: DataFrame) -> DataFrame:
    return types.select(F.col("id").alias("p_partkey"), "p_size", F.col("vcpu").alias("p_retailprice"))


def q_smallest_fit(spark, sf_dir):
    return _parts(choose.smallest_fit(choose.fitting(choose.offered(_types(spark, sf_dir), arch="PROMO"), 0, 10)))


def _chosen(spark, sf_dir, most: float):
    return _parts(choose.within(choose.smallest_fit(choose.fitting(_types(spark, sf_dir), 0, 10)), (most, INF, INF)))


def q_limit_then_check(spark, sf_dir):
    return _chosen(spark, sf_dir, 901.0)


def q_limit_then_check_kept(spark, sf_dir):
    return _chosen(spark, sf_dir, 905.0)


def q_within(spark, sf_dir):
    return _parts(choose.within(_types(spark, sf_dir), (905.0, 20.0, 1.0)))


def q_offered(spark, sf_dir):
    return _parts(choose.offered(_types(spark, sf_dir), region="Brand#11"))


#: Orders as machines: their states as one of the two providers tells them.
ORDER_STATES = {"hetzner": {"F": "off", "O": "running", "P": "starting"}, "digitalocean": {"F": "off", "O": "active", "P": "new"}}


def _orders(spark, sf_dir) -> DataFrame:
    raw = F.col("o_orderstatus")
    told = d.mapped(raw, ORDER_STATES["hetzner"], "?")
    return _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice", d.power_status(told, F.lit("hetzner")).alias("status"), raw.alias("raw_status"))


def q_status_map(spark, sf_dir):
    return _orders(spark, sf_dir).select("o_orderkey", "status", "raw_status")


def q_provider_states(spark, sf_dir):
    """Every state that one of the providers tells, and one that none does, under each of them."""
    states = [*dict.fromkeys([*d.HETZNER_STATES, *d.DO_STATES]), "odd"]
    k = F.col("o_orderkey")
    raw = F.element_at(F.array(*map(F.lit, states)), (k % len(states) + 1).cast("int"))
    provider = F.element_at(F.array(*map(F.lit, ("hetzner", "digitalocean", "other"))), (k % 3 + 1).cast("int"))
    return _t(spark, sf_dir, "orders").select("o_orderkey", provider.alias("provider"), raw.alias("raw"), d.power_status(raw, provider).alias("status"), d.settled(d.power_status(raw, provider), raw).alias("settled"))


def q_unit_norm(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", s.gb_from_mib(F.col("p_size")).alias("gb"))


def q_union_tagged(spark, sf_dir):
    customers = _t(spark, sf_dir, "customer").select(F.lit("customer").alias("provider"), F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"))
    suppliers = _t(spark, sf_dir, "supplier").select(F.lit("supplier").alias("provider"), F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("name"))
    rows, outcomes = choose.read_all({"customer": lambda: customers, "supplier": lambda: suppliers}, lambda _, df: df)
    assert all(o["ok"] for o in outcomes)
    return rows


def q_json_prop(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", s.or_dash(F.nullif(s.json_path(F.col("props"), "$.k"), F.lit(""))).alias("k"))


def q_sha(spark, sf_dir):
    p = s.preview(F.col("text"))
    return _t(spark, sf_dir, "documents").where("text is not null").select("doc_id", p["byteLength"].alias("byte_length"), p["sha256"].alias("sha256"))


def q_prefix_bound(spark, sf_dir):
    """At most 100 pages of 50 rows, in order: the bound is the feature."""
    return pages.prefix(_t(spark, sf_dir, "events"), ["event_id"], 50).select("event_id", "user_id", "event_type")


def q_decide(spark, sf_dir):
    action = F.when(F.col("o_orderkey") % 3 == 0, "start").when(F.col("o_orderkey") % 3 == 1, "stop").otherwise("delete")
    rows = _orders(spark, sf_dir).withColumn("action", action)
    return rows.select("o_orderkey", "action", "status", d.decide(F.col("action"), F.col("status")).alias("decision"), d.confirmation_required(F.col("action"), F.col("o_orderkey") % 2 == 0, F.lit(False)).alias("confirm"))


def q_response_class(spark, sf_dir):
    codes = F.element_at(F.array(*map(F.lit, (200, 400, 401, 403, 404, 409, 418, 422, 429, 500, 503))), (F.col("event_id") % 11 + 1).cast("int"))
    return _t(spark, sf_dir, "events").select("event_id", d.response_class(codes).alias("class"))


def q_retry(spark, sf_dir):
    e = F.col("event_id")
    delay = d.retry_delay(e % 2 == 0, (e % 3).cast("int"), e % 5 != 0, (e % 100).cast("double"), F.when(e % 7 == 0, 5.0))
    return _t(spark, sf_dir, "events").select("event_id", delay.alias("delay"))


def q_redacted(spark, sf_dir):
    text = F.concat(F.lit("Bearer tok."), F.col("event_id").cast("string"), F.lit(" "), F.col("event_type"))
    return _t(spark, sf_dir, "events").select("event_id", s.redacted(text).alias("line"))


def q_names(spark, sf_dir):
    padded = F.concat(F.lit(" \t"), F.col("c_name"), F.lit("\n "))
    name = F.when(F.col("c_custkey") % 10 == 0, F.lit(" \t ")).otherwise(padded)
    return _t(spark, sf_dir, "customer").select("c_custkey", s.valid_name(name).alias("name"), s.name_error(name).alias("error"))


def q_segments(spark, sf_dir):
    left = F.when(F.col("o_orderkey") % 2 == 0, "").otherwise(F.col("status"))
    return _orders(spark, sf_dir).select("o_orderkey", s.joined(left, F.col("o_orderpriority"), F.lit("")).alias("line"))


def q_durations(spark, sf_dir):
    text = F.concat((F.col("event_id") % 700).cast("string"), F.element_at(F.array(*map(F.lit, "smhx")), (F.col("event_id") % 4 + 1).cast("int")))
    rows = _t(spark, sf_dir, "events").select("event_id", s.seconds(text).alias("seconds"))
    return rows.select("event_id", "seconds", s.duration_text(F.col("seconds")).alias("shown"), s.poll_cap(F.col("seconds")).alias("polls"))


def q_alarm(spark, sf_dir):
    pct = s.percent(F.lit(None), F.col("l_quantity"), F.lit(50))
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", pct.alias("pct"), s.alarm(pct).alias("level"))


def q_compatible(spark, sf_dir):
    """Parts of the types that the dearest part has, as types that fit an image's architecture."""
    types = _types(spark, sf_dir)
    image = types.orderBy(F.desc("vcpu"), "id").limit(1).select("arch")
    return choose.compatible_types(types, image, "Brand#11").select(F.col("id").alias("p_partkey"), F.col("arch").alias("p_type"))


def q_known_ids(spark, sf_dir):
    """For each brand up to five of its part ids."""
    rows = choose.first_ids(_t(spark, sf_dir, "part"), "p_brand", "p_partkey")
    return rows.select("p_brand", F.array_join(F.col("known").cast("array<string>"), ",").alias("known"))


def q_envelope(spark, sf_dir):
    return choose.envelope(_t(spark, sf_dir, "region").orderBy("r_regionkey").select("r_regionkey", "r_name"), [])


def q_envelope_failed(spark, sf_dir):
    """Nations as providers none of which could be read."""
    kinds = F.element_at(F.array(*map(F.lit, ("Auth", "Transport", "NotFound", "Usage"))), (F.col("n_nationkey") % 4 + 1).cast("int"))
    outcomes = _t(spark, sf_dir, "nation").select(F.col("n_name").alias("provider"), kinds.alias("error"), F.lit(None).cast("string").alias("reason"))
    return choose.failed_envelope(choose.list_outcome(outcomes))


def q_text_table(spark, sf_dir):
    return choose.text_table(_t(spark, sf_dir, "nation"), ["n_nationkey", "n_name", "n_regionkey"], ["n_nationkey"])


def _picked(values, by=None):
    """One of the values for each event."""
    return F.element_at(F.array(*map(F.lit, values)), ((F.col("event_id") if by is None else by) % len(values) + 1).cast("int"))


def q_exit_code(spark, sf_dir):
    error = F.nullif(_picked([*d.EXIT_CODES, ""]), F.lit(""))
    return _t(spark, sf_dir, "events").select("event_id", error.alias("error"), d.exit_code(error).cast("int").alias("code"))


def q_log_level(spark, sf_dir):
    env = F.nullif(_picked(["trace", "DEBUG", "info", "warn", "error", "none", "loud", ""]), F.lit(""))
    return _t(spark, sf_dir, "events").select("event_id", d.log_level(env, F.col("event_id") % 3 == 0).alias("level"))


def q_providers(spark, sf_dir):
    flag, default = F.nullif(_picked(["all", "hetzner", ""]), F.lit("")), F.nullif(_picked(["digitalocean", ""]), F.lit(""))
    return _t(spark, sf_dir, "events").select("event_id", F.array_join(d.providers(flag, default, F.col("event_id") % 5 < 3), ",").alias("providers"))


def q_evaluate(spark, sf_dir):
    e = F.col("event_id")
    outcome = d.evaluate(_picked(["status", "absent", "created"]), F.lit("off"), _picked(["running", "success", "error", "success"], F.floor(e / 3)), _picked(["running", "off", "transitioning", "unknown", "off"], F.floor(e / 12)), e % 7 == 0)
    return _t(spark, sf_dir, "events").select("event_id", outcome.alias("outcome"))


def q_short_count(spark, sf_dir):
    return _t(spark, sf_dir, "orders").select("o_orderkey", s.short_count(F.col("o_orderkey") * 500).alias("shown"))


def q_greeting(spark, sf_dir):
    name = F.when(F.col("c_custkey") % 3 > 0, F.concat(F.lit("\t "), F.col("c_name"), F.lit(" ")))
    return _t(spark, sf_dir, "customer").select("c_custkey", s.greeting(name).alias("line"))


def q_in_range(spark, sf_dir):
    e = F.col("event_id")
    found = s.in_range(F.concat((e % 400).cast("string"), F.lit(", "), (e % 50 + 20).cast("string")))
    return _t(spark, sf_dir, "events").select("event_id", F.array_join(found.cast("array<string>"), "+").alias("widths"))


def q_inventory(spark, sf_dir):
    """Customers and suppliers in the order of an inventory, each with its position."""
    return choose.numbered(q_union_tagged(spark, sf_dir), ["provider", "name", "id"], "position").select("position", "provider", "id", "name")


def q_collected_pages(spark, sf_dir):
    """Each customer's orders as pages that lead to the next; some lead back to the first, some to none there is."""
    k, w = F.col("o_orderkey"), Window.partitionBy("o_custkey").orderBy("o_orderkey")
    following = F.when(k % 13 == 0, F.first(k).over(w)).when(k % 17 == 0, -k).otherwise(F.lead(k).over(w))
    orders = _t(spark, sf_dir, "orders")
    found = orders.select(F.col("o_custkey").alias("account"), k.alias("cursor"), following.alias("next"))
    return stored.walked(found, orders.groupBy(F.col("o_custkey").alias("account")).agg(F.min(k).alias("cursor")))


def q_waited(spark, sf_dir):
    """Events as polls of machines, of ten machines at a time."""
    e, wait = F.col("event_id"), F.expr("event_id div 200 * 10 + user_id % 10")
    failed = F.when(F.col("event_type") == "error", _picked(["Transport", "Auth", "NotFound", ""]))
    status = d.mapped(F.col("event_type"), {"view": "transitioning", "click": "transitioning", "purchase": "off", "signup": "running"})
    seen = _t(spark, sf_dir, "events").select(wait.alias("wait_id"), e.alias("at"), F.when(failed == "", "error").alias("action_state"), status.alias("status"), F.lit(False).alias("missing"), F.nullif(failed, F.lit("")).alias("error"))
    w = F.col("wait_id")
    asked = seen.select("wait_id").distinct().select("wait_id", _picked(["status", "absent", "created"], w).alias("kind"), _picked(["running", "off"], w).alias("target"), F.nullif(_picked(["30s", "2m", "", "1m", "1h"], w), F.lit("")).alias("timeout"), (F.floor(w / 10) * 200).alias("started"))
    return waiting.waited(asked, seen).drop("status")


def q_redacted_record(spark, sf_dir):
    """Events as nested records with secrets at several depths, as JSON."""
    k = F.col("event_id").cast("string")
    deep = F.struct(F.lit("x").alias("userData"), F.col("event_type").alias("w"))
    some = F.parse_json(F.concat(F.lit('{"a":[{"token":"x","b":"Bearer q'), k, F.lit('"},'), k, F.lit('],"userData":{"c":1}}')))
    record = F.struct("event_id", F.concat(F.lit("t"), k).alias("token"), F.concat(F.lit("Bearer x"), k).alias("note"), F.array(F.struct(k.alias("Authorization"), F.concat(F.lit("dop_v1_"), k).alias("v"), deep.alias("deep"))).alias("list"), some.alias("any"))
    rows = _t(spark, sf_dir, "events").select("event_id", record.alias("r"))
    return rows.select("event_id", F.to_json(s.redacted_record(F.col("r"), rows.schema["r"].dataType)).alias("record"))


def q_decoded(spark, sf_dir):
    """Events as items of pages, of which some do not decode."""
    k = F.col("event_id").cast("string")
    forms = [F.col("props"), F.lit('{"k": "x"}'), F.concat(F.lit('{"k": '), k, F.lit(', "n": {"m": "x"}}')), F.lit('{"k": '), F.concat(F.lit('{"n": {"m": '), k, F.lit("}}")), F.concat(F.lit('{"k": '), k, F.lit(', "n": {"m": '), k, F.lit('}, "more": [1]}'))]
    items = _t(spark, sf_dir, "events").select("event_id", F.element_at(F.array(*forms), (F.col("event_id") % 6 + 1).cast("int")).alias("item"))
    return pages.decoded(items, "k bigint, n struct<m:bigint>", required=("k",)).select("event_id", "record.k", "record.n.m", "error", "path")


def q_first_wins(spark, sf_dir):
    """For each nation the first of its rich suppliers, or else of its rich customers, or else its own name."""
    suppliers = _t(spark, sf_dir, "supplier").where("s_acctbal > 9000").select(F.col("s_nationkey").alias("setting"), F.col("s_suppkey").alias("rank"), F.col("s_name").alias("value"), F.lit("supplier").alias("source"))
    customers = _t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("setting"), (F.col("c_custkey") + 10**9).alias("rank"), F.when(F.col("c_acctbal") > 9900, F.col("c_name")).alias("value"), F.lit("customer").alias("source"))
    nations = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("setting"), F.lit(10**15).alias("rank"), F.col("n_name").alias("value"), F.lit("nation").alias("source"))
    return settings.first_wins(suppliers.unionByName(customers).unionByName(nations), "setting", "rank").select("setting", "value", "source")


def q_listing(spark, sf_dir):
    """Three providers read at once: one whole, one that ends early, one that fails; rows and the outcome of all."""
    none = F.lit(None).cast("string").alias("reason")
    customers = lambda: _t(spark, sf_dir, "customer").select(F.lit("hetzner").alias("provider"), F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") == 0, "pages").alias("reason"))
    suppliers = lambda: _t(spark, sf_dir, "supplier").select(F.lit("digitalocean").alias("provider"), F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("name"), none)
    nations = lambda: _t(spark, sf_dir, "nation").select(F.lit("other").alias("provider"), F.raise_error(F.lit("no token")).cast("string").alias("id"), F.col("n_name").alias("name"), none)
    rows, outcome = choose.listing({"hetzner": customers, "digitalocean": suppliers, "other": nations}, spark)
    told = outcome.select("ok", "exit_code", F.array_join(F.transform("errors", lambda x: F.concat_ws(":", x["provider"], x["code"])), ",").alias("errors"))
    return rows.join(F.broadcast(told)).select("position", "provider", "id", "ok", "exit_code", "errors")


def q_details(spark, sf_dir):
    """Orders as one provider's raw machines, to the detail view."""
    k, null = F.col("o_orderkey"), F.lit(None)
    raw = _t(spark, sf_dir, "orders").select(
        k.alias("id"), F.concat(F.lit("vm-"), F.col("o_custkey").cast("string")).alias("name"), d.mapped(F.col("o_orderstatus"), ORDER_STATES["hetzner"], "odd").alias("status"),
        F.struct(F.col("o_orderpriority").alias("name"), (k % 16 / 2.0).cast("double").alias("memory"), F.lit(40.0).alias("disk")).alias("server_type"), F.struct(F.struct(F.lit("fsn1").alias("name")).alias("location")).alias("datacenter"),
        F.struct(F.struct(F.when(k % 3 > 0, F.concat(F.lit("10.0.0."), (k % 250).cast("string"))).alias("ip")).alias("ipv4"), F.struct(null.cast("string").alias("ip")).alias("ipv6")).alias("public_net"),
        F.struct(F.lit("ubuntu").alias("name")).alias("image"), null.cast("timestamp").alias("created"), F.create_map(F.lit("b"), F.col("o_orderstatus"), F.lit("a"), (k % 7).cast("string")).alias("labels"), F.when(k % 2 == 0, F.array(F.col("o_custkey"))).alias("volumes"),
    )
    return normalize.details(normalize.hetzner_vms(raw))


def q_droplets(spark, sf_dir):
    """Orders as the other provider's raw machines, to records."""
    k = F.col("o_orderkey")
    text = lambda at: F.concat(F.lit(at), k.cast("string"))
    ip = lambda at, kind: F.struct(text(at).alias("ip_address"), F.lit(kind).alias("type"))
    v4 = F.when(k % 4 > 0, F.array(ip("10.", "private"), ip("9.", "public"), ip("8.", "public"))).otherwise(F.array(ip("10.", "private")))
    raw = _t(spark, sf_dir, "orders").select(
        k.alias("id"), text("d").alias("name"), d.mapped(F.col("o_orderstatus"), ORDER_STATES["digitalocean"], "odd").alias("status"), F.lit("s-1").alias("size_slug"), F.struct(F.lit("fra1").alias("slug")).alias("region"),
        F.struct(v4.alias("v4"), F.when(k % 3 > 0, F.array(ip("::", "public"), ip("::f", "public"))).alias("v6")).alias("networks"), F.struct(k.alias("id"), F.when(k % 5 > 0, F.lit("ubuntu")).alias("slug")).alias("image"),
        F.lit(None).cast("timestamp").alias("created_at"), F.array(F.col("o_orderpriority")).alias("tags"), F.when(k % 2 == 0, F.array(text("v"))).alias("volume_ids"), (k % 5 * 512.0 + 512).alias("memory"), F.lit(25.0).alias("disk"), F.lit(1).alias("vcpus"),
    )
    return normalize.digitalocean_vms(raw).select("id", "status", "raw_status", "memory_gb", "ipv4", "ipv6", "image", F.element_at("tags", 1).alias("tag"), F.array_join(F.transform("attached", lambda x: x["id"]), ",").alias("attached"))


def q_unchanged(spark, sf_dir):
    """Whether an order, as a machine, stands as the customer's one before it did."""
    rows = _orders(spark, sf_dir)
    told = F.struct("status", "raw_status")
    both = rows.select("o_orderkey", told.alias("after"), F.lag(told).over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("before"))
    return both.where("before is not null").select("o_orderkey", d.unchanged(F.col("before"), F.col("after")).alias("unchanged"))


def q_user_data(spark, sf_dir):
    """Whether a provider takes a text as user data."""
    provider = F.when(F.col("doc_id") % 2 == 0, "hetzner").otherwise("digitalocean")
    return _t(spark, sf_dir, "documents").where("text is not null").select("doc_id", s.user_data_ok(F.col("text"), provider).alias("ok"))


def q_wrap(spark, sf_dir):
    """Names of nations with tabs expanded, wrapped to six columns, and their width."""
    text = blocks.expand_tabs(F.concat(F.lit("a\t"), F.col("n_name")))
    return _t(spark, sf_dir, "nation").select("n_nationkey", F.array_join(blocks.wrap(text, F.lit(6)), "|").alias("lines"), blocks.width_of(text).alias("width"))


def _diagrams(spark, sf_dir):
    """Orders as documents: a heading, a block of another language, and one or two blocks of text with tabs, of which some
    have a marker; some blocks are left open, and some documents have none."""
    k = F.col("o_orderkey").cast("string")
    two = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("\n<!-- draw-visual:m"), k, F.lit(" -->\n~~~~text\nclerk "), F.col("o_custkey").cast("string"), F.lit("\n~~~\n~~~~~"))).otherwise("")
    body = F.when(F.col("o_orderkey") % 7 == 0, "none").otherwise(F.concat(F.lit("```text\n"), k, F.lit("\t"), F.col("o_orderpriority"), F.lit("\nend"), F.when(F.col("o_orderkey") % 11 == 0, "").otherwise("\n```"), two))
    return _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("# of "), F.col("o_orderstatus"), F.lit("\n```sh\nls\n```\n"), body).alias("text"))


def q_fenced(spark, sf_dir):
    return blocks.fenced(_diagrams(spark, sf_dir)).select("id", "block", "label", "line", F.array_join("lines", "|").alias("lines"), "error")


def q_measured(spark, sf_dir):
    """The blocks' widest lines, and which are over each of two widths."""
    found = blocks.measured(blocks.fenced(_diagrams(spark, sf_dir)), [14, 70])
    return found.select("id", "block", "width", "columns", F.array_join("wrapped_lines", ",").alias("wrapped"), "overflow", "sha256")


def q_options(spark, sf_dir):
    """Orders as sources of diagrams, of which some begin with a line of options, and some of these leave a quote open."""
    k = F.col("o_orderkey")
    line = F.concat(F.when(k % 2 == 0, "%% ").otherwise("' "), F.lit("draw-visual: --id "), k.cast("string"), F.lit(" '"), F.col("o_orderpriority"), F.when(k % 5 == 0, "").otherwise("'"), F.lit(" \\x\nmore"))
    return _t(spark, sf_dir, "orders").select("o_orderkey", F.array_join(s.options(F.when(k % 3 == 0, "plain").otherwise(line)), "|").alias("options"))


def q_stale_embeds(spark, sf_dir):
    """Orders as documents with one embedded diagram each, against the diagrams of their customers as they are now."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    path = F.concat(F.lit("c"), c.cast("string"))
    fence = F.when(k % 5 == 0, "none").otherwise(F.concat(F.lit("```\n"), F.when(k % 2 == 0, "old").otherwise(F.concat(F.lit("Customer#"), F.lpad(c.cast("string"), 9, "0"))), F.when(k % 7 == 0, "").otherwise("\n```")))
    docs = _t(spark, sf_dir, "orders").select(k.alias("id"), F.concat(F.lit("a\n<!-- draw-visual: "), path, F.lit(" -->\n"), fence).alias("text"))
    now = _t(spark, sf_dir, "customer").where("c_custkey % 4 > 0").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("path"), F.array("c_name").alias("lines"))
    return blocks.embeds(docs, now)


def q_types(spark, sf_dir):
    """Parts as the raw types of both providers: some are withdrawn, some will be, some are not available."""
    k, when = F.col("p_partkey"), F.lit("2020-01-01 00:00:00").cast("timestamp")
    part = _t(spark, sf_dir, "part")
    gone = F.when(k % 3 == 0, "2019-12-31 00:00:00").when(k % 3 == 1, "2020-01-02 00:00:00").cast("timestamp")
    one = part.select(F.col("p_name").alias("name"), F.col("p_size").alias("cores"), (k % 9 / 2.0).alias("memory"), F.lit(20.0).alias("disk"), F.col("p_type").alias("architecture"), F.array(F.struct(F.col("p_brand").alias("location")), F.struct(F.lit("fsn1").alias("location"))).alias("prices"), F.struct(gone.alias("unavailable_after")).alias("deprecation"))
    two = part.select((k % 4 > 0).alias("available"), F.col("p_name").alias("slug"), F.col("p_size").alias("vcpus"), (k % 9 * 512).alias("memory"), F.lit(25.0).alias("disk"), F.array("p_brand").alias("regions"))
    both = normalize.hetzner_types(one, when).withColumn("provider", F.lit("hetzner")).unionByName(normalize.digitalocean_types(two).withColumn("provider", F.lit("digitalocean")))
    return both.select("provider", "id", "vcpu", s.number_text(F.col("memory_gb")).alias("memory"), s.number_text(F.col("disk_gb")).alias("disk"), "arch", F.array_join("available_regions", ",").alias("regions"))


def q_actions(spark, sf_dir):
    """Line items as actions of one provider, looked up by the two ids that stand for one."""
    line = _t(spark, sf_dir, "lineitem")
    vm, action = F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")
    raw = line.select(F.concat(vm, F.lit(":"), action).alias("id"), d.mapped(F.col("l_returnflag"), {"A": "in-progress", "R": "completed", "N": "errored"}, "odd").alias("status"))
    found = normalize.action_status(raw, "digitalocean").withColumn("at", normalize.droplet_action(F.col("id")))
    return found.select("at.vm_id", "at.action_id", "state", "message")


def q_membership(spark, sf_dir):
    """Machines that are wanted by provider and id, and are there or not: orders ask for customers, of which a third place
    none, and for others that there can't be."""
    vms = q_union_tagged(spark, sf_dir).where("provider = 'customer'")
    wanted = _t(spark, sf_dir, "orders").select(F.lit("customer").alias("provider"), F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("x"), F.col("o_custkey").cast("string"))).otherwise(F.col("o_custkey").cast("string")).alias("id"))
    return choose.found_or_error(vms, wanted.distinct()).select("id", F.col("vm.name").alias("name"), "error")


def q_usage_errors(spark, sf_dir):
    """Events as requests whose options do or do not go together."""
    e = F.col("event_id")
    given = lambda by, value: F.when(e % by == 0, value)
    asked = _t(spark, sf_dir, "events").select(
        "event_id", _picked(["create", "list", "stop", "start"]).alias("command"), _picked(["all", "hetzner", "hetzner"]).alias("provider"), given(5, "t1").alias("type"), given(3, (e % 4).cast("double")).alias("vcpu"), given(2, (e % 7 / 2.0)).alias("memory"),
        given(11, F.lit(10.0)).alias("disk"), given(13, (e % 900).cast("int")).alias("timeout"), (e % 2 == 0).alias("wait"), (e % 17 == 0).alias("yes"), (e % 19 == 0).alias("dry_run"),
    )
    return choose.usage_errors(asked).select("event_id", F.array_join("usage", "; ").alias("usage"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for k, f in globals().items() if k.startswith("q_")}

_PICK = "SELECT p_partkey, p_size, p_retailprice FROM part WHERE p_size >= 10 ORDER BY p_size, p_retailprice, p_partkey LIMIT 1"
_STATUS = "CASE o_orderstatus WHEN 'F' THEN 'off' WHEN 'O' THEN 'running' WHEN 'P' THEN 'transitioning' ELSE 'unknown' END"

_DIAGRAMS = """d AS (SELECT o_orderkey AS id, o_orderstatus, o_orderpriority, 'clerk ' || o_custkey AS o_clerk, CASE WHEN o_orderkey % 7 = 0 THEN 'no block' WHEN o_orderkey % 11 = 0 THEN 'unclosed fence' END AS error FROM orders),
b AS (SELECT *, unnest(CASE WHEN error IS NULL AND id % 3 = 0 THEN [1, 2] ELSE [1] END) AS n FROM d)"""

ORACLE: dict[str, str] = {
    "q_smallest_fit": "SELECT p_partkey, p_size, p_retailprice FROM part WHERE p_type = 'PROMO' AND p_size >= 10 ORDER BY p_size, p_retailprice, p_partkey LIMIT 1",
    "q_limit_then_check": f"SELECT * FROM ({_PICK}) WHERE p_retailprice <= 901",
    "q_limit_then_check_kept": f"SELECT * FROM ({_PICK}) WHERE p_retailprice <= 905",
    "q_status_map": f"SELECT o_orderkey, {_STATUS} AS status, o_orderstatus AS raw_status FROM orders",
    "q_unit_norm": "SELECT p_partkey, p_size / CAST(1024 AS DOUBLE) AS gb FROM part",
    "q_union_tagged": "SELECT 'customer' AS provider, CAST(c_custkey AS VARCHAR) AS id, c_name AS name FROM customer UNION ALL SELECT 'supplier', CAST(s_suppkey AS VARCHAR), s_name FROM supplier",
    "q_json_prop": "SELECT event_id, coalesce(json_extract_string(props, '$.k'), '-') AS k FROM events",
    "q_sha": "SELECT doc_id, octet_length(encode(text)) AS byte_length, sha256(text) AS sha256 FROM documents WHERE text IS NOT NULL",
    "q_prefix_bound": "SELECT event_id, user_id, event_type FROM events ORDER BY event_id LIMIT 5000",
    "q_decide": f"""SELECT o_orderkey, action, status, CASE WHEN status NOT IN ('running', 'off') THEN 'Conflict' WHEN action = 'delete' THEN 'Mutate'
WHEN action = 'stop' AND status = 'running' OR action = 'start' AND status = 'off' THEN 'Mutate' ELSE 'Noop' END AS decision,
action IN ('stop', 'delete') AND o_orderkey % 2 <> 0 AS confirm
FROM (SELECT o_orderkey, {_STATUS} AS status, CASE o_orderkey % 3 WHEN 0 THEN 'start' WHEN 1 THEN 'stop' ELSE 'delete' END AS action FROM orders)""",
    "q_response_class": """SELECT event_id, CASE WHEN c BETWEEN 200 AND 299 THEN NULL WHEN c IN (401, 403) THEN 'Auth' WHEN c = 404 THEN 'NotFound' WHEN c = 429 OR c >= 500 THEN 'Transport' ELSE 'ProviderRejected' END AS class
FROM (SELECT event_id, [200, 400, 401, 403, 404, 409, 418, 422, 429, 500, 503][event_id % 11 + 1] AS c FROM events)""",
    "q_retry": """SELECT event_id, CASE WHEN event_id % 2 = 0 AND a < 2 AND event_id % 5 <> 0 AND event_id % 100 + w <= 90 THEN w END AS delay
FROM (SELECT event_id, event_id % 3 AS a, CAST(CASE WHEN event_id % 7 = 0 THEN 5 WHEN event_id % 3 = 0 THEN 1 ELSE 3 END AS DOUBLE) AS w FROM events)""",
    "q_redacted": "SELECT event_id, 'Bearer [redacted] ' || event_type AS line FROM events",
    "q_names": "SELECT c_custkey, CASE WHEN c_custkey % 10 <> 0 AND length(c_name) BETWEEN 1 AND 64 THEN c_name END AS name, CASE WHEN c_custkey % 10 = 0 OR length(c_name) = 0 THEN 'empty' WHEN length(c_name) > 64 THEN 'too long' END AS error FROM customer",
    "q_segments": f"SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE {_STATUS} || ' | ' || o_orderpriority END AS line FROM orders",
    "q_durations": """SELECT event_id, seconds, CASE WHEN seconds >= 60 THEN CAST(seconds // 60 AS VARCHAR) || 'm' || lpad(CAST(seconds % 60 AS VARCHAR), 2, '0') || 's' ELSE CAST(seconds AS VARCHAR) || 's' END AS shown,
CAST(ceil(seconds / 2.0) AS BIGINT) + 1 AS polls
FROM (SELECT event_id, CASE WHEN u < 3 AND n > 0 AND n * m <= 600 THEN CAST(n * m AS INTEGER) END AS seconds
FROM (SELECT event_id, event_id % 700 AS n, event_id % 4 AS u, CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 60 ELSE 3600 END AS m FROM events))""",
    "q_alarm": "SELECT l_orderkey, l_linenumber, pct, CASE WHEN pct > 90 THEN 'red' WHEN pct > 70 THEN 'yellow' ELSE 'green' END AS level FROM (SELECT l_orderkey, l_linenumber, round(100 * l_quantity / 50) AS pct FROM lineitem)",
    "q_compatible": "SELECT p_partkey, p_type FROM part WHERE p_brand = 'Brand#11' AND p_type = (SELECT p_type FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 1)",
    "q_known_ids": "SELECT p_brand, string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY p_partkey) AS known FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part) WHERE n <= 5 GROUP BY p_brand",
    "q_envelope": """SELECT '{"schemaVersion":1,"ok":true,"data":[' || string_agg('{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}', ',' ORDER BY r_regionkey) || '],"errors":[]}' AS json FROM region""",
    "q_text_table": """WITH w AS (SELECT CAST(greatest(max(length(n_name)), 6) AS INTEGER) AS n FROM nation)
SELECT CAST(0 AS BIGINT) AS row, 'N_NATIONKEY  ' || rpad('N_NAME', n, ' ') || '  N_REGIONKEY' AS line FROM w UNION ALL
SELECT row_number() OVER (ORDER BY n_nationkey), rtrim(rpad(CAST(n_nationkey AS VARCHAR), 11, ' ') || '  ' || rpad(n_name, n, ' ') || '  ' || rpad(CAST(n_regionkey AS VARCHAR), 11, ' ')) FROM nation, w""",
    "q_within": "SELECT p_partkey, p_size, p_retailprice FROM part WHERE p_retailprice <= 905 AND p_size <= 20",
    "q_offered": "SELECT p_partkey, p_size, p_retailprice FROM part WHERE p_brand = 'Brand#11'",
    "q_provider_states": """SELECT o_orderkey, provider, raw, status, CASE WHEN status <> 'transitioning' THEN status WHEN raw IN ('stopping', 'archive') THEN 'off' WHEN raw = 'deleting' THEN 'unknown' ELSE 'running' END AS settled
FROM (SELECT o_orderkey, provider, raw, CASE WHEN provider <> 'other' AND raw = 'off' OR provider = 'hetzner' AND raw = 'off' THEN 'off'
WHEN provider = 'hetzner' AND raw = 'running' OR provider = 'digitalocean' AND raw = 'active' THEN 'running'
WHEN provider = 'hetzner' AND raw IN ('initializing', 'starting', 'stopping', 'rebuilding', 'migrating', 'deleting') OR provider = 'digitalocean' AND raw IN ('new', 'archive') THEN 'transitioning' ELSE 'unknown' END AS status
FROM (SELECT o_orderkey, ['hetzner', 'digitalocean', 'other'][o_orderkey % 3 + 1] AS provider, ['running', 'off', 'initializing', 'starting', 'stopping', 'rebuilding', 'migrating', 'deleting', 'active', 'new', 'archive', 'odd'][o_orderkey % 12 + 1] AS raw FROM orders))""",
    "q_envelope_failed": """SELECT '{"schemaVersion":1,"ok":false,"data":null,"errors":[' || string_agg('{"code":"' || ['auth', 'transport', 'not-found', 'usage'][n_nationkey % 4 + 1] || '","message":"' || ['Auth', 'Transport', 'NotFound', 'Usage'][n_nationkey % 4 + 1]
|| '","provider":"' || n_name || '","vmId":null,"actionId":null,"requestId":null}', ',' ORDER BY n_name) || ']}' AS json, CAST([5, 5, 6, 2][arg_min(n_nationkey, n_name) % 4 + 1] AS INTEGER) AS exit_code FROM nation""",
    "q_exit_code": """SELECT event_id, error, CAST(CASE WHEN error IS NULL THEN 0 WHEN error IN ('Usage', 'ConfigInvalid') THEN 2 WHEN error = 'Conflict' THEN 3 WHEN error = 'LimitExceeded' THEN 4
WHEN error IN ('Auth', 'ProviderRejected', 'Transport', 'OutcomeUnknown', 'IncompleteInventory') THEN 5 WHEN error = 'NotFound' THEN 6 WHEN error = 'Aborted' THEN 7 WHEN error = 'WaitTimeout' THEN 9 ELSE 1 END AS INTEGER) AS code
FROM (SELECT event_id, ['Usage', 'ConfigInvalid', 'Conflict', 'LimitExceeded', 'Auth', 'ProviderRejected', 'Transport', 'OutcomeUnknown', 'IncompleteInventory', 'NotFound', 'Aborted', 'WaitTimeout', 'Internal', NULL][event_id % 14 + 1] AS error FROM events)""",
    "q_log_level": """SELECT event_id, coalesce(['Trace', 'Debug', 'Info', 'Warn', 'Error', 'None', NULL, NULL][event_id % 8 + 1], CASE WHEN event_id % 3 = 0 THEN 'Debug' ELSE 'Warn' END) AS level FROM events""",
    "q_providers": """SELECT event_id, CASE WHEN chosen = 'all' THEN CASE WHEN event_id % 5 < 3 THEN 'digitalocean,hetzner' END ELSE chosen END AS providers
FROM (SELECT event_id, coalesce(['all', 'hetzner', NULL][event_id % 3 + 1], ['digitalocean', NULL][event_id % 2 + 1]) AS chosen FROM events)""",
    "q_evaluate": """SELECT event_id, CASE WHEN action = 'error' THEN 'failed' WHEN kind = 'absent' THEN CASE WHEN gone THEN 'settled' ELSE 'pending' END
WHEN gone THEN CASE WHEN kind = 'created' THEN 'pending' ELSE 'failed' END
WHEN kind = 'status' AND status = 'off' OR kind = 'created' AND status IN ('running', 'off') THEN 'settled' ELSE 'pending' END AS outcome
FROM (SELECT event_id, ['status', 'absent', 'created'][event_id % 3 + 1] AS kind, ['running', 'success', 'error', 'success'][event_id // 3 % 4 + 1] AS action,
['running', 'off', 'transitioning', 'unknown', 'off'][event_id // 12 % 5 + 1] AS status, event_id % 7 = 0 AS gone FROM events)""",
    "q_short_count": """SELECT o_orderkey, CASE WHEN n < 1000 THEN CAST(n AS VARCHAR) ELSE CAST(n // 1000 + CASE WHEN n % 1000 > 500 OR n % 1000 = 500 AND n // 1000 % 2 = 1 THEN 1 ELSE 0 END AS VARCHAR) || 'k' END AS shown
FROM (SELECT o_orderkey, o_orderkey * 500 AS n FROM orders)""",
    "q_greeting": "SELECT c_custkey, 'Hello, ' || CASE WHEN c_custkey % 3 > 0 THEN c_name ELSE 'world' END || '!' AS line FROM customer",
    "q_in_range": "SELECT event_id, CASE WHEN event_id % 400 BETWEEN 20 AND 300 THEN (event_id % 400) || '+' || (event_id % 50 + 20) END AS widths FROM events",
    "q_inventory": "SELECT row_number() OVER (ORDER BY provider, name, id) AS position, provider, id, name FROM (SELECT 'customer' AS provider, CAST(c_custkey AS VARCHAR) AS id, c_name AS name FROM customer UNION ALL SELECT 'supplier', CAST(s_suppkey AS VARCHAR), s_name FROM supplier)",
    "q_collected_pages": """WITH RECURSIVE p AS (
  SELECT o_custkey AS account, CAST(o_orderkey AS VARCHAR) AS cursor, CAST(CASE WHEN o_orderkey % 13 = 0 THEN first_value(o_orderkey) OVER w WHEN o_orderkey % 17 = 0 THEN -o_orderkey ELSE lead(o_orderkey) OVER w END AS VARCHAR) AS next
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)
), walk AS (
  SELECT o_custkey AS account, CAST(NULL AS VARCHAR) AS cursor, CAST(min(o_orderkey) AS VARCHAR) AS next, 0 AS page, CAST([] AS VARCHAR[]) AS seen, CAST(NULL AS VARCHAR) AS reason FROM orders GROUP BY o_custkey
  UNION ALL
  SELECT account, wanted, after, page + CASE WHEN why IS NULL THEN 1 ELSE 0 END, list_append(seen, wanted), why FROM (
    SELECT w.account, w.next AS wanted, p.next AS after, w.page, w.seen, CASE WHEN list_contains(w.seen, w.next) THEN 'cursor' WHEN w.page >= 100 THEN 'pages' WHEN p.account IS NULL THEN 'page' END AS why
    FROM walk w LEFT JOIN p ON p.account = w.account AND p.cursor = w.next WHERE w.next IS NOT NULL AND w.reason IS NULL)
)
SELECT account, CAST(page AS INTEGER) AS page, cursor, reason FROM walk WHERE page > 0 OR reason IS NOT NULL""",
    "q_waited": """WITH o AS (
  SELECT event_id // 200 * 10 + user_id % 10 AS wait_id, event_id AS clock, CASE WHEN event_type IN ('view', 'click') THEN 'transitioning' WHEN event_type = 'purchase' THEN 'off' WHEN event_type = 'signup' THEN 'running' END AS status,
    CASE WHEN event_type = 'error' THEN ['Transport', 'Auth', 'NotFound', NULL][event_id % 4 + 1] END AS error, event_type = 'error' AND event_id % 4 = 3 AS wrong FROM events
), r AS (
  SELECT wait_id, ['status', 'absent', 'created'][wait_id % 3 + 1] AS kind, ['running', 'off'][wait_id % 2 + 1] AS target, [30, 120, 180, 60, NULL][wait_id % 5 + 1] AS deadline, wait_id // 10 * 200 AS started FROM (SELECT DISTINCT wait_id FROM o)
), s AS (
  SELECT *, CASE WHEN error = 'Auth' THEN 'aborted' WHEN error = 'Transport' THEN 'pending' WHEN wrong THEN 'failed'
    WHEN kind = 'absent' THEN CASE WHEN error = 'NotFound' THEN 'settled' ELSE 'pending' END WHEN error = 'NotFound' THEN CASE WHEN kind = 'created' THEN 'pending' ELSE 'failed' END
    WHEN kind = 'status' AND status = target OR kind = 'created' AND status IN ('running', 'off') THEN 'settled' ELSE 'pending' END AS state
  FROM (SELECT o.*, kind, target, deadline, started, row_number() OVER (PARTITION BY o.wait_id ORDER BY clock) AS n FROM o JOIN r ON o.wait_id = r.wait_id WHERE clock <= started + deadline)
  WHERE n <= ceil(deadline / 2.0) + 1
), f AS (SELECT wait_id, min(n) FILTER (WHERE state <> 'pending') AS first, count(*) AS polls FROM s GROUP BY wait_id),
t AS (
  SELECT r.wait_id, CASE WHEN r.deadline IS NULL THEN 'usage' ELSE coalesce(s.state, 'timeout') END AS outcome, s.error AS told, coalesce(f.first, f.polls, 0) AS polls, coalesce(s.clock - r.started, r.deadline) AS elapsed_s
  FROM r LEFT JOIN f ON f.wait_id = r.wait_id LEFT JOIN s ON s.wait_id = r.wait_id AND s.n = f.first
)
SELECT wait_id, outcome, CASE outcome WHEN 'failed' THEN 'ProviderRejected' WHEN 'aborted' THEN told WHEN 'timeout' THEN 'WaitTimeout' WHEN 'usage' THEN 'Usage' END AS error, CAST(polls AS BIGINT) AS polls, CAST(elapsed_s AS DOUBLE) AS elapsed_s,
  CAST(CASE outcome WHEN 'settled' THEN 0 WHEN 'timeout' THEN 9 WHEN 'usage' THEN 2 ELSE 5 END AS INTEGER) AS exit_code FROM t""",
    "q_redacted_record": """SELECT event_id, '{"event_id":' || event_id || ',"note":"Bearer [redacted]","list":[{"v":"[redacted]","deep":{"w":"' || event_type || '"}}],"any":{"a":[{"b":"Bearer [redacted]"},' || event_id || ']}}' AS record FROM events""",
    "q_decoded": """SELECT event_id, CASE event_id % 6 WHEN 0 THEN CAST(json_extract(props, '$.k') AS BIGINT) WHEN 5 THEN event_id END AS k, CASE event_id % 6 WHEN 5 THEN event_id END AS m,
CASE WHEN event_id % 6 BETWEEN 1 AND 4 THEN 'ProviderRejected' END AS error, [NULL, '$.k', '$.n.m', '$', '$.k', NULL][event_id % 6 + 1] AS path FROM events""",
    "q_first_wins": """SELECT setting, value, source FROM (SELECT *, row_number() OVER (PARTITION BY setting ORDER BY rank) AS n FROM (
  SELECT s_nationkey AS setting, s_suppkey AS rank, s_name AS value, 'supplier' AS source FROM supplier WHERE s_acctbal > 9000
  UNION ALL SELECT c_nationkey, c_custkey + 1000000000, c_name, 'customer' FROM customer WHERE c_acctbal > 9900
  UNION ALL SELECT n_nationkey, 1000000000000000, n_name, 'nation' FROM nation)) WHERE n = 1""",
    "q_listing": """SELECT row_number() OVER (ORDER BY provider, name, id) AS position, provider, id, false AS ok, CAST(5 AS INTEGER) AS exit_code, 'hetzner:incomplete-inventory,other:transport' AS errors
FROM (SELECT 'hetzner' AS provider, CAST(c_custkey AS VARCHAR) AS id, c_name AS name FROM customer WHERE c_custkey <> 0 UNION ALL SELECT 'digitalocean', CAST(s_suppkey AS VARCHAR), s_name FROM supplier)""",
    "q_details": f"""SELECT 'hetzner' AS provider, CAST(o_orderkey AS VARCHAR) AS id, 'vm-' || o_custkey AS name, o_orderpriority AS type_id, 'fsn1' AS region, {_STATUS} AS status,
CASE o_orderstatus WHEN 'F' THEN 'off' WHEN 'O' THEN 'running' WHEN 'P' THEN 'starting' ELSE 'odd' END AS raw_status, CASE WHEN o_orderkey % 3 > 0 THEN '10.0.0.' || (o_orderkey % 250) ELSE '-' END AS ipv4, '-' AS ipv6, 'ubuntu' AS image,
(o_orderkey % 16 // 2) || CASE WHEN o_orderkey % 2 = 1 THEN '.5' ELSE '' END AS ram_gb, '40' AS disk_gb, '-' AS created, 'a=' || (o_orderkey % 7) || ', b=' || o_orderstatus AS labels,
CASE WHEN o_orderkey % 2 = 0 THEN 'volume:' || o_custkey ELSE '-' END AS attached FROM orders""",
    "q_droplets": f"""SELECT CAST(k AS VARCHAR) AS id, {_STATUS} AS status, CASE o_orderstatus WHEN 'F' THEN 'off' WHEN 'O' THEN 'active' WHEN 'P' THEN 'new' ELSE 'odd' END AS raw_status, (k % 5 + 1) / 2.0::DOUBLE AS memory_gb,
CASE WHEN k % 4 > 0 THEN '9.' || k END AS ipv4, CASE WHEN k % 3 > 0 THEN '::' || k END AS ipv6, CASE WHEN k % 5 > 0 THEN 'ubuntu' ELSE CAST(k AS VARCHAR) END AS image, o_orderpriority AS tag, CASE WHEN k % 2 = 0 THEN 'v' || k ELSE '' END AS attached
FROM (SELECT *, o_orderkey AS k FROM orders)""",
    "q_unchanged": """SELECT o_orderkey, o_orderstatus = before AS unchanged FROM (SELECT o_orderkey, o_orderstatus, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders) WHERE before IS NOT NULL""",
    "q_user_data": "SELECT doc_id, octet_length(encode(text)) <= CASE WHEN doc_id % 2 = 0 THEN 32768 ELSE 65536 END AS ok FROM documents WHERE text IS NOT NULL",
    "q_wrap": "SELECT n_nationkey, 'a     |  ' || array_to_string(regexp_extract_all(substr(n_name, 1, 4) || chr(10) || substr(n_name, 5), '[^' || chr(10) || ']{1,6}'), '|') AS lines, CAST(8 + length(n_name) AS INTEGER) AS width FROM nation",
    "q_fenced": f"""WITH {_DIAGRAMS}
SELECT id, CAST(CASE WHEN error IS NULL THEN n END AS INTEGER) AS block, CASE WHEN error IS NULL THEN CASE n WHEN 1 THEN 'of ' || o_orderstatus ELSE 'm' || id END END AS label, CAST(CASE WHEN error IS NULL THEN CASE n WHEN 1 THEN 6 ELSE 11 END END AS INTEGER) AS line,
CASE WHEN error IS NULL THEN CASE n WHEN 1 THEN id || chr(9) || o_orderpriority || '|end' ELSE o_clerk || '|~~~' END END AS lines, error FROM b""",
    "q_measured": f"""WITH {_DIAGRAMS}, m AS (SELECT id, n, CASE n WHEN 1 THEN id || chr(9) || o_orderpriority || chr(10) || 'end' ELSE o_clerk || chr(10) || '~~~' END AS x,
CASE n WHEN 1 THEN (length(CAST(id AS VARCHAR)) // 8 + 1) * 8 + length(o_orderpriority) ELSE length(o_clerk) END AS w, CASE n WHEN 1 THEN 6 ELSE 11 END AS place FROM b WHERE error IS NULL)
SELECT id, CAST(n AS INTEGER) AS block, CAST(width AS INTEGER) AS width, CAST(w AS INTEGER) AS "columns", CASE WHEN w > width THEN CAST(place AS VARCHAR) ELSE '' END AS wrapped, w > width AS overflow, sha256(x) AS sha256 FROM m, (SELECT unnest([14, 70]) AS width)""",
    "q_options": """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '' WHEN o_orderkey % 5 > 0 THEN '--id|' || o_orderkey || '|' || o_orderpriority || '|x' END AS options FROM orders""",
    "q_stale_embeds": """SELECT o_orderkey AS id, CASE WHEN k > 1 THEN 'c' || o_custkey END AS path, CAST(CASE WHEN k > 1 THEN 2 END AS INTEGER) AS line,
CASE k WHEN 0 THEN 'line 2: a marker without a fenced block' WHEN 1 THEN 'line 3: unclosed fence' ELSE CASE WHEN o_custkey % 4 = 0 OR o_custkey NOT IN (SELECT c_custkey FROM customer) THEN 'not rendered' WHEN o_orderkey % 2 = 0 THEN 'stale' END END AS problem
FROM (SELECT *, CASE WHEN o_orderkey % 5 = 0 THEN 0 WHEN o_orderkey % 7 = 0 THEN 1 ELSE 2 END AS k FROM orders)""",
    "q_types": """SELECT 'hetzner' AS provider, p_name AS id, p_size AS vcpu, (p_partkey % 9 // 2) || CASE WHEN p_partkey % 9 % 2 = 1 THEN '.5' ELSE '' END AS memory, '20' AS disk, p_type AS arch, p_brand || ',fsn1' AS regions FROM part WHERE p_partkey % 3 <> 0
UNION ALL SELECT 'digitalocean', p_name, p_size, (p_partkey % 9 // 2) || CASE WHEN p_partkey % 9 % 2 = 1 THEN '.5' ELSE '' END, '25', 'x86', p_brand FROM part WHERE p_partkey % 4 > 0""",
    "q_actions": """SELECT CAST(l_orderkey AS VARCHAR) AS vm_id, CAST(l_linenumber AS VARCHAR) AS action_id, CASE l_returnflag WHEN 'A' THEN 'running' WHEN 'R' THEN 'success' WHEN 'N' THEN 'error' ELSE 'unknown' END AS state, CAST(NULL AS VARCHAR) AS message FROM lineitem""",
    "q_membership": """SELECT DISTINCT CASE WHEN o_orderkey % 5 = 0 THEN 'x' ELSE '' END || o_custkey AS id, CASE WHEN o_orderkey % 5 > 0 THEN c_name END AS name, CASE WHEN o_orderkey % 5 = 0 OR c_custkey IS NULL THEN 'NotFound' END AS error FROM orders LEFT JOIN customer ON c_custkey = o_custkey""",
    "q_usage_errors": """SELECT event_id, concat_ws('; ', CASE WHEN timeout IS NOT NULL AND event_id % 2 <> 0 THEN 'timeout requires wait' END, CASE WHEN timeout > 600 THEN 'timeout is over 10 minutes' END,
CASE WHEN type IS NOT NULL AND (vcpu IS NOT NULL OR memory IS NOT NULL) THEN 'type excludes vcpu and memory' END, CASE WHEN command = 'create' AND type IS NULL AND (vcpu IS NULL OR memory IS NULL) THEN 'create takes a type, or vcpu and memory' END,
CASE WHEN disk IS NOT NULL AND (vcpu IS NULL OR memory IS NULL) THEN 'disk goes with vcpu and memory only' END, CASE WHEN event_id % 3 = 0 AND command <> 'list' THEN 'all providers are for list only' END,
CASE WHEN event_id % 17 = 0 AND command NOT IN ('stop', 'delete') THEN 'yes is for stop and delete only' END, CASE WHEN event_id % 19 = 0 AND command = 'list' THEN 'dry-run is for changes only' END,
CASE WHEN vcpu = 0 THEN 'vcpu is no positive whole number' END, CASE WHEN memory = 0 THEN 'memory is not positive' END) AS usage
FROM (SELECT event_id, ['create', 'list', 'stop', 'start'][event_id % 4 + 1] AS command, CASE WHEN event_id % 5 = 0 THEN 't1' END AS type, CASE WHEN event_id % 3 = 0 THEN event_id % 4 END AS vcpu, CASE WHEN event_id % 2 = 0 THEN event_id % 7 END AS memory,
CASE WHEN event_id % 11 = 0 THEN 10 END AS disk, CASE WHEN event_id % 13 = 0 THEN event_id % 900 END AS timeout FROM events)""",
}
