"""Maps the TPC-H-like test tables to the field-sales model (see FIXTURES.md).

Every test row is used: a test table is mapped whole, and the change sets hold one
change per row of the table they come from.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldbeat.functions.columns import day, id_number, instant, make_id
from fieldbeat.functions.merge import assign_ids
from fieldbeat.operators.scoring import score_merchants
from fieldbeat.operators.scope import active
from fieldbeat.schema import ID_PREFIX, RULES
from fieldbeat.sources.tables import Tables

AS_OF = date(2024, 1, 30)
NOW = datetime(2024, 1, 30, 12)
EARLIER = datetime(2024, 1, 28, 9)

EVENT_ACTIONS = {
    "signup": "LOGIN", "view": "VIEW_MERCHANT", "click": "VIEW_DASHBOARD",
    "purchase": "UPDATE_ACTION_STATUS", "error": "EXPORT_DATA",
}
EVENT_RESOURCES = {
    "signup": "auth", "view": "merchant", "click": "dashboard",
    "purchase": "recommendation", "error": "report",
}
EVENT_OUTCOMES = {
    "purchase": "Successful", "click": "Completed",
    "view": "Follow-up Needed", "signup": "Partially Successful", "error": "Not Available",
}


# Landed rows are damaged by the remainder of their number by this step, the second of a key by
# another one.
LANDING_STEP = 17
# The remainder of a row's number by this step tells which rule it breaks, if any.
DAMAGE_STEP = 17
DAMAGE_ID = {"chat_messages": "session_id"}
# Key values that several rows get; those of references exist.
SAME_KEY = {"id": "same", "email": "same@example.com", "merchant_id": "m01", "signal_date": AS_OF,
            "score_date": AS_OF, "session_id": "cs01", "position": 0}


def damages(name: str) -> dict[str, list[tuple[int, object]]]:
    """For each column of a table the remainders at which it gets another value, and the value."""
    rules = RULES[name]
    steps: list[dict[str, object]] = [{c: SAME_KEY[c] for c in key} for key in rules.unique]
    steps += [{c: None} for c in rules.not_null]
    steps += [{c: "none of these"} for c in rules.allowed]
    steps += [{c: "nobody"} for c in rules.references]
    steps += [{c: "x" * (length + 1)} for c, length in rules.max_length.items()]
    found: dict[str, list[tuple[int, object]]] = {}
    for remainder, step in enumerate(steps):
        for column, value in step.items():
            found.setdefault(column, []).append((remainder, value))
    return found


def _choose(column: Column, values: dict[str, str]) -> Column:
    chosen = F.lit(None).cast("string")
    for key, value in values.items():
        chosen = F.when(column == key, F.lit(value)).otherwise(chosen)
    return chosen


def _order_customer() -> Column:
    """The customer an order counts for: some have none of their own, so that merchants without
    signals and recommendations occur."""
    customer = F.col("o_custkey")
    return F.when(customer % 53 == 7, customer - 1).otherwise(customer)


def _pick(number: Column, *values: str) -> Column:
    """The value at index ``number``."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (number + 1).cast("int"))


class TestData:
    """Raw test tables of one scale, and the model tables derived from them."""

    __test__ = False

    def __init__(self, spark: SparkSession, sf_dir: str, tables: Tables | None = None):
        self.spark, self.sf_dir = spark, sf_dir
        self.tables = tables or Tables(lambda name: getattr(self, f"_{name}")())

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def count(self, name: str) -> Column:
        return self.raw(name).agg(F.count("*")).scalar()

    def _nations(self) -> DataFrame:
        return self.raw("nation").join(
            self.raw("region"), F.col("n_regionkey") == F.col("r_regionkey")
        )

    def _user_id(self, number: Column) -> Column:
        """An existing user: Admin, Manager or DSP, by ``number`` modulo their count."""
        return make_id("u", 1 + number % (self.count("supplier") + 6))

    def _owner(self) -> Column:
        """The DSP of an order's merchant."""
        return make_id("u", 7 + _order_customer() % self.count("supplier"))

    # Model tables

    def _users(self) -> DataFrame:
        none = F.lit(None).cast("string")

        def user(number, email, name, role, region, area, manager, is_active):
            return [
                make_id("u", number.cast("bigint")).alias("id"), email.alias("email"),
                F.sha2(email, 256).alias("password_hash"), name.alias("full_name"),
                F.lit(role).alias("role"), region.alias("region"), area.alias("area"),
                manager.alias("manager_id"), is_active.alias("is_active"),
                instant(NOW).alias("created_at"), instant(NOW).alias("updated_at"),
            ]

        region, key = F.col("r_regionkey"), F.col("s_suppkey")
        admin = self.raw("region").where(region == 0).select(*user(
            region + 1, F.concat(F.lit("admin."), F.lower("r_name"), F.lit("@example.com")),
            F.lit("System Admin"), "Admin",
            F.col("r_name"), none, none, F.lit(True)))
        managers = self.raw("region").select(*user(
            region + 2, F.concat(F.lit("mgr"), region.cast("string"), F.lit("@example.com")),
            F.concat(F.lit("Manager "), F.col("r_name")), "Manager",
            F.col("r_name"), none, none, F.lit(True)))
        reps = self.raw("supplier").join(
            self._nations(), F.col("s_nationkey") == F.col("n_nationkey")
        ).select(*user(
            key + 7, F.concat(F.lit("dsp"), key.cast("string"), F.lit("@example.com")),
            F.col("s_name"), "DSP", F.col("r_name"), F.col("n_name"),
            make_id("u", (region + 2).cast("bigint")), key % 20 != 19))
        return admin.unionByName(managers).unionByName(reps)

    def _merchants(self) -> DataFrame:
        key = F.col("c_custkey")
        tier = (F.col("c_nationkey") * 3 + F.floor(key / 7)) % 20
        return self.raw("customer").join(
            self._nations(), F.col("c_nationkey") == F.col("n_nationkey")
        ).select(
            make_id("m", key + 1).alias("id"),
            F.col("c_name").alias("merchant_name"),
            F.col("r_name").alias("region"),
            F.when(F.floor(key / 11) % 40 != 0, F.col("n_name")).alias("area"),
            F.when(tier < 2, "Gold").when(tier < 7, "Silver").when(tier < 15, "Bronze")
            .otherwise("New").alias("tier"),
            F.col("c_mktsegment").alias("category"),
            F.concat(F.lit("+639"), F.substring("c_name", -9, 9)).alias("contact_number"),
            F.concat(key.cast("string"), F.lit(" Main St., "), F.col("n_name")).alias("address"),
            ((key % 115).cast("decimal(10,0)") / 10).cast("decimal(10,7)").alias("latitude"),
            (120 + (key % 70).cast("decimal(10,0)") / 10).cast("decimal(10,7)").alias("longitude"),
            make_id("u", 7 + key % self.count("supplier")).alias("assigned_dsp_id"),
            ((F.floor(key / 3) + F.col("c_nationkey")) % 25 != 0).alias("is_active"),
            F.date_add(F.lit("2022-01-01").cast("date"), (key % 730).cast("int"))
            .alias("onboarding_date"),
            instant(NOW).alias("created_at"), instant(NOW).alias("updated_at"),
        )

    def _merchant_signals(self) -> DataFrame:
        first = F.col("first_order")
        daily = (
            self.raw("orders").withColumn("o_custkey", _order_customer())
            .groupBy("o_custkey", (F.col("o_orderkey") % 7).alias("days_ago"))
            .agg(
                F.min("o_orderkey").alias("first_order"),
                F.sum(F.col("o_totalprice").cast("decimal(12,2)")).alias("total"),
                F.count_if(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).alias("urgent"),
            )
        )
        return daily.join(
            self.raw("customer").select("c_custkey", "c_acctbal"),
            F.col("o_custkey") == F.col("c_custkey"),
        ).select(
            make_id("ms", first + 1).alias("id"),
            make_id("m", F.col("o_custkey") + 1).alias("merchant_id"),
            F.date_sub(day(AS_OF), F.col("days_ago").cast("int")).alias("signal_date"),
            F.floor(F.col("total") / 10000).cast("int").alias("transaction_volume"),
            (((first * 37) % 15000 - 7500).cast("decimal(10,0)") / 100).cast("decimal(5,2)")
            .alias("transaction_trend"),
            (first % 46).cast("int").alias("days_since_visit"),
            F.col("urgent").cast("int").alias("complaint_count"),
            _pick(first % 4, "Active", "Inactive", "Pending", "None").alias("campaign_status"),
            F.col("c_acctbal").cast("decimal(12,2)").alias("wallet_balance"),
            (1 + first % 8).cast("int").alias("active_products"),
            instant(NOW).alias("created_at"),
        )

    def _daily_scores(self) -> DataFrame:
        scores = score_merchants(self.tables.merchant_signals, active(self.tables.merchants))
        # Ids need no global order here: merchant and date already make a unique number.
        number = id_number(F.col("merchant_id"), "m") * 10 + F.datediff(
            day(AS_OF), "score_date")
        return scores.select(
            make_id("ds", number).alias("id"), "*", instant(NOW).alias("created_at")
        )

    def _recommendations(self) -> DataFrame:
        key, status = F.col("o_orderkey"), F.col("o_orderstatus")
        return self.raw("orders").select(
            make_id("r", key + 1).alias("id"),
            make_id("m", _order_customer() + 1).alias("merchant_id"),
            F.col("o_orderpriority").alias("recommended_action"),
            F.lit(None).cast("string").alias("action_explanation"),
            F.when(key % 13 != 0, (key % 101).cast("decimal(5,0)") / 100).cast("decimal(3,2)")
            .alias("confidence_score"),
            F.when(status == "F", "Done").when(status == "O", "New")
            .when(key % 2 == 0, "In Progress").otherwise("Deferred").alias("status"),
            F.when(status == "F", instant(EARLIER)).alias("status_updated_at"),
            F.when(status == "F", self._owner()).alias("status_updated_by"),
            F.when(key % 97 != 0, F.date_sub(day(AS_OF), (key % 5).cast("int")))
            .alias("recommendation_date"),
            instant(NOW).alias("created_at"),
        )

    def _visit_history(self) -> DataFrame:
        key = F.col("user_id")
        customers = self.raw("customer").select(F.col("c_custkey").alias("user_id"))
        return self.raw("events").join(customers, "user_id", "left_semi").select(
            make_id("vh", F.col("event_id") + 1).alias("id"),
            make_id("m", key + 1).alias("merchant_id"),
            make_id("u", 7 + key % self.count("supplier")).alias("dsp_id"),
            F.col("ts").cast("date").alias("visit_date"),
            F.col("event_type").alias("visit_notes"),
            _choose(F.col("event_type"), EVENT_OUTCOMES).alias("outcome"),
            (10 + F.floor("value") % 51).cast("int").alias("duration_mins"),
            instant(NOW).alias("created_at"),
        )

    def _audit_logs(self) -> DataFrame:
        return self.raw("events").select(
            make_id("al", F.col("event_id") + 1).alias("id"),
            self._user_id(F.col("user_id")).alias("user_id"),
            _choose(F.col("event_type"), EVENT_ACTIONS).alias("action"),
            _choose(F.col("event_type"), EVENT_RESOURCES).alias("resource"),
            F.lit(None).cast("string").alias("resource_id"),
            F.col("props").alias("details"), F.lit(None).cast("string").alias("ip_address"),
            F.col("ts").cast("timestamp_ntz").alias("created_at"),
        )

    def _chat_sessions(self) -> DataFrame:
        asked = F.when(F.col("role") == "user", F.col("turn"))
        updated = F.expr("make_dt_interval(0, 0, conv_id % 100000, 0)")
        return self.raw("conversations").groupBy("conv_id").agg(
            F.min_by("text", asked).alias("first_question")
        ).select(
            make_id("cs", F.col("conv_id") + 1).alias("id"),
            self._user_id(F.col("conv_id")).alias("user_id"),
            F.substring("first_question", 1, 100).alias("title"),
            instant(NOW).alias("created_at"),
            (instant(NOW) - updated).alias("updated_at"),
        )

    def _chat_messages(self) -> DataFrame:
        return self.raw("conversations").select(
            make_id("cs", F.col("conv_id") + 1).alias("session_id"),
            F.col("turn").alias("position"), "role", F.col("text").alias("content"),
        )

    # Change sets

    def signal_deltas(self) -> DataFrame:
        """One row per customer; a seventh of them say "no change" by nulls."""
        key = F.col("c_custkey")
        changes = key % 7 != 3

        def given(value: Column, data_type: str) -> Column:
            return F.when(changes, value).cast(data_type)

        return self.raw("customer").select(
            make_id("m", key + 1).alias("merchant_id"),
            given(((key * 13) % 3001 - 1500).cast("decimal(10,0)") / 10000, "decimal(6,4)")
            .alias("volume_pct"),
            given(((key * 17) % 1001 - 500).cast("decimal(10,0)") / 100, "decimal(5,2)")
            .alias("trend_delta"),
            given(key % 3 - 1, "int").alias("complaint_step"),
            given(((key * 31) % 100001 - 50000).cast("decimal(10,0)") / 100, "decimal(12,2)")
            .alias("wallet_delta"),
        )

    def status_changes(self) -> DataFrame:
        """One row per event: a third aim at one order, some ids lie beyond the last order."""
        event = F.col("event_id")
        orders = self.count("orders")
        owners = self.raw("orders").select(
            "o_orderkey",
            self._owner().alias("owner_id"),
        )
        return self.raw("events").select(
            event.alias("seq"),
            F.when(event % 3 == 0, 4)
            .otherwise((F.floor(event / 2) * 7) % (orders + F.floor(orders / 2)))
            .cast("bigint").alias("order_number"),
        ).join(
            owners, F.col("order_number") == F.col("o_orderkey"), "left"
        ).select(
            "seq",
            make_id("r", F.col("order_number") + 1).alias("rec_id"),
            _pick(F.col("seq") % 7, "NEW", "IN_PROGRESS", "DONE", "DEFERRED", "Pending", "Done",
                  "bogus").alias("status"),
            F.when(F.col("seq") % 5 == 0, F.lit("u07"))
            .otherwise(F.coalesce("owner_id", F.lit("u07"))).alias("user_id"),
            F.when(F.col("seq") % 11 == 0, F.lit("Admin")).otherwise(F.lit("DSP")).alias("role"),
        )

    def _admin_changes(self, *columns: Column) -> DataFrame:
        """One change per supplier, by the Admin; a seventeenth by a Manager."""
        key = F.col("s_suppkey")
        return self.raw("supplier").select(
            key.alias("seq"), F.lit("u01").alias("caller_id"),
            F.when(key % 17 == 0, F.lit("Manager")).otherwise(F.lit("Admin")).alias("caller_role"),
            *columns,
        )

    def _target_user(self) -> Column:
        """The supplier's DSP, for a ninth of them an id that does not exist."""
        key = F.col("s_suppkey")
        unknown = make_id("u", key + 7 + self.count("supplier"))
        return F.when(key % 9 == 8, unknown).otherwise(make_id("u", key + 7))

    def user_creates(self) -> DataFrame:
        key = F.col("s_suppkey")
        number = key.cast("string")
        taken = F.concat(F.lit("dsp"), number, F.lit("@example.com"))
        twice = F.concat(F.lit("new"), F.floor(key / 2).cast("string"), F.lit("@example.com"))
        return self._admin_changes(
            F.when(key % 8 == 0, taken).otherwise(twice).alias("email"),
            F.concat(F.lit("secret"), number).alias("password"),
            F.concat(F.lit("New "), F.col("s_name")).alias("full_name"),
            _pick(key % 3, "DSP", "Manager", "Bogus").alias("role"),
            F.lit("ASIA").alias("region"), F.lit(None).cast("string").alias("area"),
            F.when(key % 5 == 4, F.lit("u00")).when(key % 5 == 3, F.lit("u04"))
            .alias("manager_id"),
        )

    def user_updates(self) -> DataFrame:
        key = F.col("s_suppkey")
        none = F.lit(None).cast("string")
        some = key % 12 != 1
        return self._admin_changes(
            self._target_user().alias("user_id"),
            F.when(some, F.concat(F.lit("Renamed "), F.col("s_name"))).alias("full_name"),
            F.when(some & (key % 10 == 4), F.lit("admin.africa@example.com"))
            .when(some & (key % 10 == 6),
                  F.concat(F.lit("moved"), F.floor(key / 20).cast("string"), F.lit("@example.com")))
            .alias("email"),
            none.alias("region"),
            F.when(some & (key % 3 == 0), F.lit("Moved")).alias("area"),
            F.when(some & (key % 7 == 2), F.lit("u02")).when(some & (key % 7 == 5), F.lit("u00"))
            .alias("manager_id"),
            F.when(some & (key % 4 == 0), F.lit(False)).alias("is_active"),
        )

    def users_and_trainees(self) -> DataFrame:
        """The users and one more DSP per supplier, to whom nothing refers yet."""
        number = F.col("s_suppkey") + 7 + self.count("supplier")
        email = F.concat(F.lit("trainee"), F.col("s_suppkey").cast("string"), F.lit("@example.com"))
        trainees = self.raw("supplier").select(
            make_id("u", number).alias("id"), email.alias("email"),
            F.sha2(email, 256).alias("password_hash"), F.col("s_name").alias("full_name"),
            F.lit("DSP").alias("role"), F.lit("ASIA").alias("region"), F.lit(True).alias("is_active"),
            instant(NOW).alias("created_at"), instant(NOW).alias("updated_at"),
        )
        return self.tables.users.unionByName(trainees, allowMissingColumns=True)

    def user_deletes(self) -> DataFrame:
        """Each supplier's DSP; for two ninths a trainee (each twice) or an unknown id."""
        key, suppliers = F.col("s_suppkey"), self.count("supplier")
        trainee = make_id("u", (F.floor(key / 18) * 18 + 15).cast("bigint") + suppliers)
        unknown = make_id("u", key + 7 + 2 * suppliers)
        return self._admin_changes(
            F.when(key % 9 == 8, trainee).when(key % 9 == 7, unknown)
            .otherwise(make_id("u", key + 7)).alias("user_id"))

    def role_changes(self) -> DataFrame:
        """Every two suppliers aim at one user, so some roles change twice."""
        key = F.col("s_suppkey")
        unknown = make_id("u", key + 7 + self.count("supplier"))
        target = F.when(key % 9 == 8, unknown).otherwise(
            make_id("u", F.floor(key / 2).cast("bigint") + 7))
        return self._admin_changes(
            target.alias("user_id"), _pick(key % 4, "Manager", "Admin", "Bogus", "DSP").alias("role")
        )

    def assignments(self) -> DataFrame:
        """One row per customer; Admin, Managers and one unknown user occur as targets."""
        key = F.col("c_custkey")
        return self.raw("customer").select(
            key.alias("seq"), F.lit("u01").alias("caller_id"),
            F.when(key % 17 == 0, F.lit("DSP")).otherwise(F.lit("Admin")).alias("caller_role"),
            F.when(key % 23 == 5, make_id("m", key + 1 + self.count("customer")))
            .otherwise(make_id("m", key + 1)).alias("merchant_id"),
            make_id("u", F.floor(key / 10).cast("bigint") % (self.count("supplier") + 7) + 1)
            .alias("assigned_dsp_id"),
        )

    def briefs(self) -> DataFrame:
        """One row per customer and so per merchant; not every caller may see the merchant."""
        key = F.col("c_custkey")
        own = make_id("u", 7 + key % self.count("supplier"))
        return self.raw("customer").select(
            key.alias("seq"), make_id("m", key + 1).alias("merchant_id"),
            F.when(key % 18 != 0, F.concat(F.lit("Brief for "), F.col("c_name")))
            .otherwise("").alias("text"),
            F.when(key % 4 == 0, F.lit("u01")).when(key % 4 == 1, F.lit("u02"))
            .when(key % 4 == 2, F.lit("u07")).otherwise(own).alias("user_id"),
            _pick(key % 4, "Admin", "Manager", "DSP", "DSP").alias("role"),
        )

    def chat_turns(self) -> DataFrame:
        """One turn per message of a user, with the answer that follows it: to the own, another
        user's or a new session."""
        conv = F.col("conv_id")
        answers = self.raw("conversations").where(F.col("role") == "assistant").select(
            "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
        session = F.when(conv % 3 == 0, make_id("cs", conv + 1)).when(
            conv % 3 == 1, make_id("cs", conv + 2))
        asked = self.raw("conversations").where(F.col("role") == "user")
        return asked.join(answers, ["conv_id", "turn"], "left").select(
            (conv * 1_000_000 + F.col("turn")).alias("seq"),
            self._user_id(conv).alias("user_id"),
            session.alias("session_id"),
            F.col("text").alias("message"), "answer",
        )

    def next_day_signals(self) -> DataFrame:
        """All signals one day later, twice: most meet a stored signal, the others are new. The
        second row of a key has the higher number, but the lower id as text."""
        number = id_number(F.col("id"), "ms").cast("string")
        first = self.tables.merchant_signals.withColumns({
            "id": F.concat(F.lit("ms9"), number),
            "signal_date": F.date_add("signal_date", 1),
            "campaign_status": F.lit("None"),
            "active_products": F.lit(0),
        })
        second = self.tables.merchant_signals.withColumns({
            "id": F.concat(F.lit("ms10"), number),
            "signal_date": F.date_add("signal_date", 1),
            "transaction_volume": F.col("transaction_volume") + 1,
        })
        return first.unionByName(second)

    def landed_lines(self) -> DataFrame:
        """``next_day_signals`` as lines of JSON, with the number of the signal they come from.
        Some are damaged, by the remainder of that number, the second row of a key by another step
        than the first: cut off, a text for a number, a missing merchant, a status that is not
        allowed, an id of another form."""
        second = F.col("id").startswith("ms10")
        rows = self.next_day_signals().withColumn(
            "_signal", F.substr("id", F.when(second, 5).otherwise(4)).cast("bigint"))
        kind = F.col("_signal") % F.when(second, 19).otherwise(LANDING_STEP)
        rows = rows.withColumn("_kind", kind).withColumns({
            "merchant_id": F.when(F.col("_kind") != 3, F.col("merchant_id")),
            "campaign_status": F.when(F.col("_kind") == 4, "none of these").otherwise(F.col("campaign_status")),
            "id": F.when(F.col("_kind") == 5, F.concat(F.lit("xx"), "id")).otherwise(F.col("id")),
        })
        line = F.to_json(F.struct(*self.tables.merchant_signals.columns))
        text = F.regexp_replace(line, '"transaction_volume":[0-9-]+', '"transaction_volume":"many"')
        cut = F.concat(F.lit('{"id":"'), "id", F.lit('"'))
        return rows.select("_signal", F.when(F.col("_kind") == 1, cut).when(
            F.col("_kind") == 2, text).otherwise(line).alias("line"))

    # Rows as a database has them

    def _zoned(self, table: DataFrame, **changes: Column) -> DataFrame:
        zoned = F.concat(F.col("created_at").cast("string"), F.lit("+00:00")).cast("timestamp")
        return table.withColumns({"created_at": zoned, **changes})

    def database_scores(self) -> DataFrame:
        return self._zoned(self.tables.daily_scores, score_breakdown=F.to_json("score_breakdown"))

    def database_logs(self) -> DataFrame:
        address = F.concat(F.lit("10.0.0."), (id_number(F.col("id"), "al") % 250).cast("string"))
        return self._zoned(self.tables.audit_logs, ip_address=address)

    def database_sessions(self) -> DataFrame:
        """Sessions with their messages as one JSON array, and a column of no use."""
        messages = self.tables.chat_messages.groupBy(F.col("session_id").alias("id")).agg(
            F.array_sort(F.collect_list(F.struct("position", "role", "content"))).alias("messages"))
        listed = F.transform("messages", lambda m: m.dropFields("position"))
        return self.tables.chat_sessions.join(messages, "id", "left").withColumns({
            "messages": F.to_json(listed), "other": F.lit(1)})

    def event_ids(self) -> DataFrame:
        """Every event with a fresh id, numbered from 96 by event number."""
        return assign_ids(self.raw("events").select("event_id"), "al", F.col("event_id"), 95)

    def damaged(self) -> Tables:
        """The model with every integrity rule broken on some rows, a rule by each remainder."""

        def broken(name: str) -> DataFrame:
            table = getattr(self.tables, name)
            kinds = dict(table.dtypes)
            number = id_number(F.col(DAMAGE_ID.get(name, "id")), ID_PREFIX.get(name, "cs"))
            remainder = (number % DAMAGE_STEP).cast("int")
            changed = {}
            for column, values in damages(name).items():
                value = F.col(column)
                for rule, given in values:
                    value = F.when(F.col("_rule") == rule, F.lit(given).cast(kinds[column])).otherwise(value)
                changed[column] = value
            return table.withColumn("_rule", remainder).withColumns(changed).drop("_rule")

        return self.tables.replace(**{name: broken(name) for name in RULES})
