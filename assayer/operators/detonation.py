"""Sandbox evidence: captured traffic, planted secrets and system-call traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions import fixed
from assayer.functions.text import canary_forms, excerpt, host_only, piece, public_address, public_ipv4, sanitize, severity_rank, short, signal_id, tail

RUN = ["run_id", "package"]


def haystack() -> Column:
    """Where stolen values are looked for: address, header values and body."""
    return F.concat_ws(" ", F.coalesce("url", F.lit("")), F.array_join(F.coalesce(F.map_values("headers"), F.array().cast("array<string>")), " "), F.make_valid_utf8(F.coalesce(F.col("body"), F.lit(b"")).cast("string")))


#: Characters that encoded forms are made of; longest substring that meets planted values, and characters searched at a time.
FORM, REACH, CHUNK = "[A-Za-z0-9+/=_%.~-]", 64, 4096
#: Forms broadcast at most.
BROADCAST_FORMS = 100_000


def leaks(capture: DataFrame, canaries: DataFrame) -> DataFrame:
    """(capture row, canary name) of every request that carries a form of a planted value.

    An equi-join, whatever the number of values of a run: forms meet the substrings of a haystack by their first characters,
    2^k of them (REACH at most), and forms of FORM alone are only looked for inside stretches of such characters.  Equal
    haystacks of a run are searched once.  A stream, which can't meet itself, is held against all values of the run.
    """
    sent = capture.where("kind = 'http'").withColumn("haystack", haystack())
    if capture.isStreaming:
        forms = canaries.select("run_id", F.struct("name", canary_forms("value").alias("forms")).alias("c")).groupBy("run_id").agg(F.collect_list("c").alias("planted"))
        met = F.transform(F.filter("planted", lambda c: F.exists(c["forms"], lambda f: F.col("haystack").contains(f))), lambda c: c["name"])
        return sent.join(forms, "run_id").withColumn("name", F.explode(met)).drop("haystack", "planted")
    planted = canaries.groupBy("run_id", "name", "value").agg(F.count("*").alias("copies"))
    forms = planted.select("*", F.explode(F.array_distinct(canary_forms("value"))).alias("form")).where("form IS NOT NULL").withColumn("n", F.length("form"))
    width = F.when(F.col("n") > 0, F.least(F.lit(REACH), F.expr("shiftleft(1, length(bin(n)) - 1)"))).otherwise(0)
    forms = forms.withColumn("width", width).withColumn("head", F.substring(F.col("form"), F.lit(1), F.col("width"))).withColumn("odd", ~F.col("form").rlike(f"^{FORM}*$"))
    known = forms.agg(F.collect_set(F.struct("width", "odd")).alias("kinds"), F.max("n").alias("longest"), F.count("*").alias("rows")).first()

    def stretches(width: int, odd: bool) -> Column:
        """What starts at each place: up to 2 * width - 1 characters."""
        where = rf"(?![\x{{DC00}}-\x{{DFFF}}])(?=((?s:.){{{width},{2 * width - 1}}}))" if odd else f"(?=({FORM}{{{width},{2 * width - 1}}}))"
        found = F.regexp_extract_all("chunk", F.lit(where), F.lit(1)) if width else F.array(F.lit(""))
        return F.transform(F.array_distinct(found), lambda t: F.struct(F.lit(width).alias("width"), F.lit(odd).alias("odd"), F.substring(t, F.lit(1), F.lit(width)).alias("head"), t.alias("tail")))

    kinds = [stretches(k["width"], k["odd"]) for k in sorted(known["kinds"])]
    key = F.sha2(F.encode("haystack", "UTF-8"), 256).alias("_hay")
    starts = F.sequence(F.lit(1), F.greatest(F.length("haystack"), F.lit(1)), F.lit(CHUNK))
    chunks = sent.select("run_id", key, F.explode(F.transform(starts, lambda i: F.substring(F.col("haystack"), i, F.lit(CHUNK + 2 * REACH)))).alias("chunk"))
    tails = F.concat(*kinds) if kinds else F.array().cast("array<struct<width:int,odd:boolean,head:string,tail:string>>")
    seen = chunks.select("run_id", "_hay", F.explode(tails).alias("t")).select("run_id", "_hay", "t.*")
    met = seen.join(F.broadcast(forms) if known["rows"] <= BROADCAST_FORMS else forms, ["run_id", "width", "odd", "head"])
    met = met.where(F.startswith("tail", F.substring(F.col("form"), F.lit(1), 2 * F.col("width") - 1)) | (F.col("width") == 0))
    long = F.array_sort(F.collect_set(F.when(F.col("n") >= 2 * REACH, F.col("form"))))
    met = met.groupBy("run_id", "_hay", "name", "value", "copies").agg(F.max(F.col("n") < 2 * REACH).alias("_sure"), long.alias("_long"))
    out = sent.withColumn("_hay", key).join(met.select("run_id", "_hay", F.col("name").alias("_name"), "copies", "_sure", "_long").withColumnRenamed("copies", "_copies"), ["run_id", "_hay"])
    if (known["longest"] or 0) >= 2 * REACH:
        out = out.where(F.col("_sure") | F.exists("_long", lambda f: F.col("haystack").contains(f)))
    return out.withColumn("name", F.explode(F.array_repeat("_name", F.col("_copies").cast("int")))).drop("haystack", "_hay", "_name", "_copies", "_sure", "_long")


def _told(rows: DataFrame) -> DataFrame:
    """Signals of rows with an array `w` of (category, severity, discriminator, description, shown, detail)."""
    flat = rows.select(*RUN, "seq", F.explode(F.filter("w", lambda x: x.isNotNull())).alias("w")).select(*RUN, "seq", "w.*")
    return flat.select(*RUN, "seq", signal_id(F.lit("detonation"), F.col("category"), F.concat("package", F.lit(":"), "discriminator")).alias("id"), F.lit("detonation").alias("source"), "category", "severity", severity_rank("severity").alias("sev_rank"), "description", F.col("shown").alias("excerpt"), "detail")


def _case(category: str, severity: str, discriminator: Column, description: Column, shown: Column, detail: Column) -> Column:
    return F.struct(F.lit(category).alias("category"), F.lit(severity).alias("severity"), discriminator.alias("discriminator"), description.alias("description"), shown.alias("shown"), detail.alias("detail"))


def capture_signals(capture: DataFrame, canaries: DataFrame) -> DataFrame:
    """Signals of captured traffic, not yet made one for each id: one scan for all that a record alone shows, one for planted values."""
    per_request = leaks(capture, canaries).groupBy(*RUN, "seq", "host", "url", "method").agg(F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("names"))
    line = short(F.concat_ws(" ", "method", "url"))
    stolen = _case("canary-exfiltration", "critical", F.concat_ws(":", "host", "url"), F.concat(F.lit("a planted secret ("), "names", F.lit(") was sent to "), "host"), line, F.concat(F.lit("destination="), "host"))
    bare, at, known = host_only("host"), F.concat_ws(":", "host", F.col("port").cast("string")), lambda c: c.isin(*fixed.ALLOWED_HOSTS)
    plain = (F.col("kind") == "http") & (F.coalesce("scheme", F.lit("http")) == "http") & (bare != "") & ~known(bare)
    cases = F.array(
        F.when(plain, _case("unexpected-network-destination", "medium", F.concat_ws(":", bare, "url"), F.concat(F.lit("plain request to an unknown host: "), bare), line, F.concat(F.lit("destination="), bare))),
        F.when((F.col("kind") == "connect") & ~known(F.col("host")), _case("unexpected-network-destination", "medium", at, F.concat(F.lit("connection to an unknown host: "), at), F.concat(F.lit("CONNECT "), at), F.lit("HTTPS tunnel"))),
        F.when(F.col("kind") == "blocked", _case("internal-network-probe", "high", at, F.concat(F.lit("tried to reach an internal address: "), at), at, F.concat(F.lit("resolved="), "address"))))
    return _told(per_request.withColumn("w", F.array(stolen))).unionByName(_told(capture.withColumn("w", cases)))


def release_signals(found: DataFrame, runs: DataFrame) -> DataFrame:
    """Signals of runs as signals of the releases that ran (runs: run_id, ecosystem, package, version), one for each id: the place of its first, the values of its last."""
    own = runs.select("run_id", "ecosystem", "package", "version").distinct()
    rows = found.drop("package").join(own, "run_id")
    last = F.max_by(F.struct("source", "category", "severity", "sev_rank", "description", F.array(piece(F.col("excerpt"), detail=F.col("detail"))).alias("evidence")), F.struct("run_id", "seq"))
    return rows.groupBy("ecosystem", "package", "version", "id").agg(last.alias("v")).select("ecosystem", "package", "version", "id", "v.*")


def leaked_canaries(capture: DataFrame, canaries: DataFrame) -> DataFrame:
    """(run_id, planted, leaked): the names of each run's values, and of those that left it."""
    gone = leaks(capture, canaries).groupBy("run_id").agg(F.array_sort(F.collect_set("name")).alias("leaked"))
    return canaries.groupBy("run_id").agg(F.array_sort(F.collect_set("name")).alias("planted")).join(gone, "run_id", "left").withColumn("leaked", F.coalesce("leaked", F.array().cast("array<string>")))


#: What a run can't show, in the order reports name it.
LIMITS = {
    "inspected": "requests are read through a certificate of the run; a tool that pins its own is seen as a connection alone",
    "opaque": "contents of HTTPS requests are not read, only where they go",
    "window": "what happens after the observation window of %d seconds is not seen",
    "import": "only the install and the first import are run, not code that runs in later use",
    "scripts": "only the lifecycle scripts are run, not code that a require() loads",
    "trace": "the trace is written by the user that the package runs as: evidence, but not proof against tampering",
}


def run_limits(runs: DataFrame) -> DataFrame:
    """(run_id, limits) of runs with tls_inspected, time_limit and imports (whether modules were imported)."""
    said = lambda k: F.lit(LIMITS[k])
    parts = F.array(F.when(F.col("tls_inspected"), said("inspected")).otherwise(said("opaque")), F.format_string(LIMITS["window"], "time_limit"), F.when(F.col("imports"), said("import")).otherwise(said("scripts")), said("trace"))
    return runs.select("run_id", parts.alias("limits"))


def distinct_limits(runs: DataFrame) -> DataFrame:
    """The limits of all runs, each once, in the order in which they are first met."""
    met = run_limits(runs).select("run_id", F.posexplode("limits").alias("at", "limit_text"))
    return met.groupBy("limit_text").agg(F.min(F.struct("run_id", "at")).alias("first")).select("limit_text", "first.run_id", "first.at")


def run_records(runs: DataFrame, capture: DataFrame, canaries: DataFrame, lines: DataFrame) -> DataFrame:
    """One record for each run: what was run, what was seen, and what could not be."""
    own = runs.select("run_id", "scripts", "exit_code", "timed_out", F.round("seconds", 1).alias("seconds"), "time_limit", tail("stdout").alias("stdout_tail"), tail("stderr").alias("stderr_tail"))
    return (own.join(run_summary(capture).drop("package"), "run_id", "left").join(leaked_canaries(capture, canaries), "run_id", "left")
            .join(trace_summary(lines).drop("package"), "run_id", "left").join(run_limits(runs), "run_id", "left"))


def run_summary(capture: DataFrame) -> DataFrame:
    """Counts and hosts of each run."""
    known = lambda c: c.isin(*fixed.ALLOWED_HOSTS)
    http, plain = F.col("kind") == "http", (F.col("kind") == "http") & (F.coalesce("scheme", F.lit("http")) == "http")
    bare = host_only("host")
    hosts = lambda when, c: F.array_sort(F.collect_set(F.when(when & (c != ""), c)))
    connect = F.col("kind") == "connect"
    return capture.groupBy(*RUN).agg(
        F.count_if(plain).alias("plain_http_requests"), F.count_if(http & (F.col("scheme") == "https")).alias("https_requests_inspected"),
        hosts(plain & known(bare), bare).alias("plain_expected"), hosts(plain & ~known(bare), bare).alias("plain_unexpected"),
        hosts(connect & known(F.col("host")), F.col("host")).alias("https_expected"), hosts(connect & ~known(F.col("host")), F.col("host")).alias("https_unexpected"),
        F.array_sort(F.collect_list(F.when(F.col("kind") == "blocked", F.struct("seq", F.concat_ws(":", "host", F.col("port").cast("string")).alias("at"))))).alias("blocked"),
    ).withColumn("blocked", F.transform("blocked", lambda x: x["at"]))


def trace_events(lines: DataFrame) -> DataFrame:
    """Parsed lines of traces (run_id, package, seq, line), within the first TRACE_BYTES of each."""
    size = F.sum(F.octet_length("line") + 1).over(Window.partitionBy(*RUN).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    read = lines.withColumn("_at", size - F.octet_length("line") - 1).where(F.col("_at") < fixed.TRACE_BYTES)
    p = "(?U)" + fixed.TRACE_LINE
    call, args = F.regexp_extract("line", p, 2), F.regexp_extract("line", p, 3)
    return read.where(F.col("line").rlike(p)).select(*RUN, "seq", "line", F.regexp_extract("line", p, 1).alias("pid"), call.alias("call"), args.alias("args"), F.regexp_extract_all(args, F.lit(fixed.TRACE_QUOTED), 1).alias("strings"))


def _with_inet(events: DataFrame, proxy_port: int) -> DataFrame:
    """Events with `destination`: where a connect call goes past the proxy (not loopback, not unspecified, not the proxy on a private address), else null."""
    port, address = F.regexp_extract("args", fixed.TRACE_INET, 1), F.regexp_extract("args", fixed.TRACE_INET, 2)
    told = F.struct(port.alias("port"), address.alias("address"), public_address(address).alias("public"), public_ipv4(address).isNotNull().alias("four"))
    rows = events.withColumn("_inet", F.explode(F.array(F.when((F.col("call") == "connect") & (port != ""), told))))  # a generator, so that addresses are looked at once
    at, public = F.col("_inet.address"), F.col("_inet.public")
    inner = at.rlike(r"^127\.|^0\.0\.0\.0$") | at.isin("::1", "::", "::ffff:127.0.0.1")
    shared = at.rlike(r"^100\.(?:6[4-9]|[7-9]\d|1[01]\d|12[0-7])\.|^2(?:2[4-9]|3\d)\.")
    private = F.when(F.col("_inet.four"), ~public & ~shared).otherwise(~public & ~at.rlike("(?i)^ff"))
    direct = public.isNotNull() & ~inner & ~((F.col("_inet.port") == str(proxy_port)) & private)
    return rows.withColumn("destination", F.when(direct, F.concat_ws(":", at, "_inet.port"))).drop("_inet")


def trace_signals(lines: DataFrame, states: DataFrame | None = None, proxy_port: int = 8080) -> DataFrame:
    """Signals of traces, one for each category and object of a run; `states` names runs that expected a trace."""
    events = _with_inet(trace_events(lines), proxy_port)
    target, call, args = F.get("strings", F.lit(0)), F.col("call"), F.col("args")
    found = lambda p: target.rlike("(?iu)" + p)
    is_file = call.isin(*fixed.FILE_CALLS) & target.isNotNull()
    writing = args.rlike(fixed.WRITE_FLAGS) & call.isin("openat", "openat2")
    tampering = target.startswith(fixed.TRACE_FOLDER) & (call != "openat")
    lasting = found(fixed.PERSISTENCE_PATHS) & (writing | (call != "openat"))
    secret = found(fixed.CREDENTIAL_PATHS) | target.rlike(fixed.CONTAINER_SOCKETS)
    private = target.rlike(fixed.OTHER_PROCESS) | target.rlike(fixed.HISTORY_FILES)
    what = lambda category, severity, key: F.struct(F.lit(category).alias("category"), F.lit(severity).alias("severity"), key.alias("key"))
    of_file = (F.when(tampering, what("trace-interference", "medium", target)).when(lasting, what("persistence-attempt", "high", target))
               .when(secret, what("sensitive-file-access", "high", target)).when(private, what("sensitive-file-access", "medium", target)))
    unix = F.regexp_extract(args, fixed.TRACE_UNIX, 1)
    destination = F.col("destination")
    of_connect = (F.when(args.rlike("sa_family=AF_UNIX, sun_path="), F.when(unix.rlike(fixed.CONTAINER_SOCKETS), what("sensitive-file-access", "high", unix)))
                  .when(destination.isNotNull(), what("proxy-bypass-attempt", "medium", destination)))
    told = F.filter(F.array(F.when(is_file, of_file).when(call == "connect", of_connect)), lambda x: x.isNotNull())
    seen = events.select(*RUN, "seq", "line", F.explode(told).alias("w")).select(*RUN, "seq", "line", "w.*")  # a generator, so that the cases are evaluated once
    once = seen.groupBy(*RUN, "category", "key").agg(F.min(F.struct("seq", "severity", "line")).alias("first")).select(*RUN, "first.seq", "category", "key", "first.severity", "first.line")
    if states is not None:
        ran = lines.where(F.col("line").contains(" execve(")).select("run_id").distinct()
        gone = states.where("requested and not unavailable").join(ran, "run_id", "left_anti").select(*RUN, F.lit(0).cast("long").alias("seq"), F.lit("trace-interference").alias("category"), F.lit("trace-missing").alias("key"), F.lit("medium").alias("severity"), F.lit("(no trace records)").alias("line"))
        once = once.join(states.where("requested and not unavailable").select("run_id").distinct().join(ran, "run_id", "left_semi"), "run_id", "left_semi").unionByName(gone)
    return once.select(*RUN, "seq", signal_id(F.lit("detonation"), F.col("category"), F.concat("package", F.lit(":"), "key")).alias("id"), F.lit("detonation").alias("source"), "category", "severity", severity_rank("severity").alias("sev_rank"), F.concat_ws(": ", "category", "key").alias("description"), excerpt(sanitize("line")).alias("excerpt"), F.substring(sanitize("key"), 1, 200).alias("detail"))


def trace_summary(lines: DataFrame, proxy_port: int = 8080) -> DataFrame:
    """Of each run: number of events, the first distinct processes, direct connections and files of interest, in order."""
    events = _with_inet(trace_events(lines), proxy_port)
    exe, rest = F.get("strings", F.lit(0)), F.array_join(F.slice("strings", 2, 1 << 20), " ")
    command = F.substring(rest, 1, 200)
    entry = F.substring(sanitize(F.when((command == "") | (command == exe), exe).otherwise(F.concat_ws(": ", exe, command))), 1, 110)
    started = (F.col("call") == "execve") & exe.isNotNull() & ~F.substring_index(exe, "/", -1).isin(*fixed.PROBE_TOOLS)
    kinds = F.array(F.when(started, F.struct(F.lit("processes").alias("list"), entry.alias("entry"))), F.when(F.col("destination").isNotNull(), F.struct(F.lit("direct_connects").alias("list"), F.col("destination").alias("entry"))))
    seen = events.select(*RUN, "seq", F.explode(F.filter(kinds, lambda x: x.isNotNull())).alias("k")).select(*RUN, "seq", "k.*")
    touched = trace_signals(lines, proxy_port=proxy_port).where(F.col("category").isin("persistence-attempt", "sensitive-file-access"))
    verb = F.when(F.col("category") == "persistence-attempt", "write ").when(F.col("excerpt").rlike(r"\bconnect\("), "connect ").otherwise("open ")
    every = seen.unionByName(touched.select(*RUN, "seq", F.lit("files_of_interest").alias("list"), F.concat(verb, "detail").alias("entry")))
    order = Window.partitionBy(*RUN, "list").orderBy("seq")
    first = every.groupBy(*RUN, "list", "entry").agg(F.min("seq").alias("seq")).withColumn("n", F.row_number().over(order)).where((F.col("n") <= fixed.TRACE_LISTED) | (F.col("list") == "files_of_interest"))
    of = lambda name: F.transform(F.array_sort(F.collect_list(F.when(F.col("list") == name, F.struct("n", "entry")))), lambda x: x["entry"])
    listed = first.groupBy(*RUN).agg(*(of(k).alias(k) for k in ("processes", "direct_connects", "files_of_interest")))
    return events.groupBy(*RUN).agg(F.count("*").alias("events")).join(listed, RUN, "left")
