"""Rules that users write: lines of three kinds, what they say of calls, callbacks and entries, and which of them ever applied.

A line with => names implementations: `Type => Impl, Impl`, `Type#method => Impl`, `Factory#method("KEY") => Impl` (the key can be an enum
constant's name or X.class). A line with -> says that a call calls back: `callee -> position : signature`, position r (receiver), aN or
a* (arguments), cN or c* (arguments of the constructor that made the receiver). Others name entries: `@Annotation`, `super Type#sig`,
`static sig`, `main`. Blank lines and those that begin with # say nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.selection import has

#: Rules are written by hand: a table of more lines than this is joined by a shuffle, not broadcast.
BROADCAST_LINES = 100_000

# Which methods of the JDK call back what they are given.
JDK_CALLBACKS = """
java.lang.Thread#start() -> c* : run()
java.lang.Thread#start() -> r : run()
java.lang.Thread#run() -> c* : run()
java.util.concurrent.Executor#execute(java.lang.Runnable) -> a0 : run()
java.util.concurrent.ExecutorService#submit(java.lang.Runnable) -> a0 : run()
java.util.concurrent.ExecutorService#submit(java.lang.Runnable,java.lang.Object) -> a0 : run()
java.util.concurrent.ExecutorService#submit(java.util.concurrent.Callable) -> a0 : call()
java.util.concurrent.ScheduledExecutorService#schedule(java.lang.Runnable,long,java.util.concurrent.TimeUnit) -> a0 : run()
java.util.concurrent.ScheduledExecutorService#schedule(java.util.concurrent.Callable,long,java.util.concurrent.TimeUnit) -> a0 : call()
java.util.concurrent.ScheduledExecutorService#scheduleAtFixedRate(java.lang.Runnable,long,long,java.util.concurrent.TimeUnit) -> a0 : run()
java.util.concurrent.ScheduledExecutorService#scheduleWithFixedDelay(java.lang.Runnable,long,long,java.util.concurrent.TimeUnit) -> a0 : run()
java.util.concurrent.CompletableFuture#runAsync(java.lang.Runnable) -> a0 : run()
java.util.concurrent.CompletableFuture#runAsync(java.lang.Runnable,java.util.concurrent.Executor) -> a0 : run()
java.util.concurrent.CompletableFuture#supplyAsync(java.util.function.Supplier) -> a0 : get()
java.util.concurrent.CompletableFuture#supplyAsync(java.util.function.Supplier,java.util.concurrent.Executor) -> a0 : get()
java.util.concurrent.CompletableFuture#thenApply(java.util.function.Function) -> a0 : apply(java.lang.Object)
java.util.concurrent.CompletableFuture#thenAccept(java.util.function.Consumer) -> a0 : accept(java.lang.Object)
java.util.concurrent.CompletableFuture#thenRun(java.lang.Runnable) -> a0 : run()
java.util.concurrent.CompletableFuture#thenCompose(java.util.function.Function) -> a0 : apply(java.lang.Object)
java.util.Timer#schedule(java.util.TimerTask,long) -> a0 : run()
java.util.Timer#schedule(java.util.TimerTask,long,long) -> a0 : run()
java.util.Timer#scheduleAtFixedRate(java.util.TimerTask,long,long) -> a0 : run()
java.lang.Iterable#forEach(java.util.function.Consumer) -> a0 : accept(java.lang.Object)
java.util.Map#forEach(java.util.function.BiConsumer) -> a0 : accept(java.lang.Object,java.lang.Object)
java.util.Collection#removeIf(java.util.function.Predicate) -> a0 : test(java.lang.Object)
java.util.List#sort(java.util.Comparator) -> a0 : compare(java.lang.Object,java.lang.Object)
java.util.Collections#sort(java.util.List,java.util.Comparator) -> a1 : compare(java.lang.Object,java.lang.Object)
java.util.Arrays#sort(java.lang.Object[],java.util.Comparator) -> a1 : compare(java.lang.Object,java.lang.Object)
java.util.Map#computeIfAbsent(java.lang.Object,java.util.function.Function) -> a1 : apply(java.lang.Object)
java.util.Map#computeIfPresent(java.lang.Object,java.util.function.BiFunction) -> a1 : apply(java.lang.Object,java.lang.Object)
java.util.Map#compute(java.lang.Object,java.util.function.BiFunction) -> a1 : apply(java.lang.Object,java.lang.Object)
java.util.Map#merge(java.lang.Object,java.lang.Object,java.util.function.BiFunction) -> a2 : apply(java.lang.Object,java.lang.Object)
java.util.stream.Stream#forEach(java.util.function.Consumer) -> a0 : accept(java.lang.Object)
java.util.stream.Stream#forEachOrdered(java.util.function.Consumer) -> a0 : accept(java.lang.Object)
java.util.stream.Stream#map(java.util.function.Function) -> a0 : apply(java.lang.Object)
java.util.stream.Stream#flatMap(java.util.function.Function) -> a0 : apply(java.lang.Object)
java.util.stream.Stream#filter(java.util.function.Predicate) -> a0 : test(java.lang.Object)
java.util.stream.Stream#peek(java.util.function.Consumer) -> a0 : accept(java.lang.Object)
java.util.stream.Stream#anyMatch(java.util.function.Predicate) -> a0 : test(java.lang.Object)
java.util.stream.Stream#allMatch(java.util.function.Predicate) -> a0 : test(java.lang.Object)
java.util.stream.Stream#noneMatch(java.util.function.Predicate) -> a0 : test(java.lang.Object)
java.util.stream.Stream#sorted(java.util.Comparator) -> a0 : compare(java.lang.Object,java.lang.Object)
java.util.Optional#map(java.util.function.Function) -> a0 : apply(java.lang.Object)
java.util.Optional#flatMap(java.util.function.Function) -> a0 : apply(java.lang.Object)
java.util.Optional#filter(java.util.function.Predicate) -> a0 : test(java.lang.Object)
java.util.Optional#ifPresent(java.util.function.Consumer) -> a0 : accept(java.lang.Object)
java.util.Optional#ifPresentOrElse(java.util.function.Consumer,java.lang.Runnable) -> a0 : accept(java.lang.Object)
java.util.Optional#ifPresentOrElse(java.util.function.Consumer,java.lang.Runnable) -> a1 : run()
java.util.Optional#orElseGet(java.util.function.Supplier) -> a0 : get()
""".strip().splitlines()

_SERVLETS = [
    line.replace("PKG", pkg)
    for pkg in ("javax", "jakarta")
    for line in (
        *(f"super PKG.servlet.http.HttpServlet#{m}(PKG.servlet.http.HttpServletRequest,PKG.servlet.http.HttpServletResponse)" for m in ("doGet", "doPost", "doPut", "doDelete", "service")),
        "super PKG.servlet.GenericServlet#service(PKG.servlet.ServletRequest,PKG.servlet.ServletResponse)",
        "super PKG.servlet.GenericServlet#init()",
        "super PKG.servlet.Filter#doFilter(PKG.servlet.ServletRequest,PKG.servlet.ServletResponse,PKG.servlet.FilterChain)",
        "super PKG.servlet.ServletContextListener#contextInitialized(PKG.servlet.ServletContextEvent)",
        "super PKG.servlet.ServletContextListener#contextDestroyed(PKG.servlet.ServletContextEvent)",
    )
]
_SPRING = "org.springframework"
# What the frameworks call.
ENTRY_RULES = [
    "main",
    *_SERVLETS,
    *(f"@{_SPRING}.web.bind.annotation.{a}" for a in ("RequestMapping", "GetMapping", "PostMapping", "PutMapping", "DeleteMapping", "PatchMapping", "ExceptionHandler", "InitBinder", "ModelAttribute")),
    f"@{_SPRING}.scheduling.annotation.Scheduled",
    f"@{_SPRING}.context.event.EventListener",
    f"@{_SPRING}.transaction.event.TransactionalEventListener",
    f"super {_SPRING}.context.ApplicationListener#onApplicationEvent({_SPRING}.context.ApplicationEvent)",
    f"super {_SPRING}.beans.factory.InitializingBean#afterPropertiesSet()",
    f"super {_SPRING}.beans.factory.DisposableBean#destroy()",
    f"super {_SPRING}.boot.CommandLineRunner#run(java.lang.String[])",
    f"super {_SPRING}.boot.ApplicationRunner#run({_SPRING}.boot.ApplicationArguments)",
    *(f"@{p}.annotation.{a}" for p in ("javax", "jakarta") for a in ("PostConstruct", "PreDestroy")),
    f"@{_SPRING}.kafka.annotation.KafkaListener",
    f"@{_SPRING}.amqp.rabbit.annotation.RabbitListener",
    f"@{_SPRING}.jms.annotation.JmsListener",
    *(f"super {p}.jms.MessageListener#onMessage({p}.jms.Message)" for p in ("javax", "jakarta")),
    "super org.quartz.Job#execute(org.quartz.JobExecutionContext)",
    f"super {_SPRING}.batch.core.step.tasklet.Tasklet#execute({_SPRING}.batch.core.StepContribution,{_SPRING}.batch.core.scope.context.ChunkContext)",
    "super org.apache.struts.action.Action#execute(org.apache.struts.action.ActionMapping,org.apache.struts.action.ActionForm,javax.servlet.http.HttpServletRequest,javax.servlet.http.HttpServletResponse)",
    *(f"@org.junit.jupiter.api.{a}" for a in ("Test", "BeforeEach", "AfterEach", "BeforeAll", "AfterAll")),
    "@org.junit.jupiter.params.ParameterizedTest",
    *(f"@org.junit.{a}" for a in ("Test", "Before", "After")),
    "@org.testng.annotations.Test",
]
LAUNCH = ["main(java.lang.String[])", "main()"]

_NAME = r"[A-Za-z_$][A-Za-z0-9_$]*(?:\.[A-Za-z_$][A-Za-z0-9_$]*)*"


def classified(lines: DataFrame) -> DataFrame:
    """(row, text, kind) of lines (row, text) that say something: type, callback, entry, or bad for those of no kind's form."""
    text = F.trim("text")
    arrow = F.instr(text, "->")
    callback = text.rlike(r"^\S.*?->\s*(?:r\S*|[ac](?:\*|[0-9]+))\s*:\s*\S")
    kind = F.when(F.instr(text, "=>") > 0, F.when(type_rule(text)["ok"], "type").otherwise("bad")).when(arrow > 0, F.when(callback, "callback").otherwise("bad"))
    entry = text.rlike(r"^(?:@\S+|super\s+\S+#\S+|static\s+\S+|main)$")
    return lines.where((text != "") & ~text.startswith("#")).select("row", text.alias("text"), kind.when(entry, "entry").otherwise("bad").alias("kind"))


def type_rule(text: Column) -> Column:
    """A line with => as a struct: type, method ('' for all), key and key_kind (L text, V constant, K class; '' without), impls, and ok."""
    left, right = F.trim(F.substring_index(text, "=>", 1)), F.trim(F.substring(text, F.instr(text, "=>") + 2, F.length(text)))
    inner = F.trim(F.regexp_extract(left, r"^[^(]*\((.*)\)$", 1))
    has_key = F.instr(left, "(") > 0
    quoted, literal, const = inner.rlike('^".+"$'), inner.rlike(rf"^{_NAME}\.class$"), inner.rlike(rf"^{_NAME}$")
    key = F.when(quoted, F.regexp_extract(inner, '^"(.+)"$', 1)).when(literal, F.regexp_replace(inner, r"\.class$", "")).when(const, inner)
    kind = F.when(quoted, "L").when(literal, "K").when(const, "V")
    head = F.trim(F.substring_index(left, "(", 1))
    has_method = F.instr(head, "#") > 0
    type_, method = F.trim(F.substring_index(head, "#", 1)), F.when(has_method, F.trim(F.regexp_extract(head, "#(.*)$", 1))).otherwise("")
    impls = F.filter(F.transform(F.split(right, ","), lambda x: F.trim(x)), lambda x: x != "")
    ok = (type_ != "") & (~has_method | (method != "")) & (F.size(impls) > 0) & (~has_key | (left.endswith(")") & key.isNotNull() & has_method))
    return F.struct(type_.alias("type"), method.alias("method"), F.when(has_key, F.coalesce(key, F.lit(""))).otherwise("").alias("key"), F.when(has_key, F.coalesce(kind, F.lit(""))).otherwise("").alias("key_kind"), impls.alias("impls"), F.coalesce(ok, F.lit(False)).alias("ok"))


def type_rules(lines: DataFrame) -> DataFrame:
    """(row, type, method, key, key_kind, impls) of the lines of kind type."""
    return classified(lines).where("kind = 'type'").select("row", type_rule(F.col("text")).alias("r")).select("row", "r.type", "r.method", "r.key", "r.key_kind", "r.impls")


def callback_rules(lines: DataFrame) -> DataFrame:
    """(row, callee, place, index, sig): place r, a or c; index null for the receiver, -1 for any argument."""
    parts = classified(lines).where("kind = 'callback'").select("row", F.trim(F.substring_index("text", "->", 1)).alias("callee"), F.regexp_extract("text", r"->\s*([^:]*?)\s*:\s*(.*)$", 1).alias("p"), F.regexp_extract("text", r"->\s*([^:]*?)\s*:\s*(.*)$", 2).alias("sig"))
    place = F.substring("p", 1, 1)
    index = F.when(place == "r", None).when(F.col("p").endswith("*"), -1).otherwise(F.expr("try_cast(substring(p, 2) AS int)"))
    return parts.select("row", "callee", place.alias("place"), index.cast("int").alias("index"), F.trim("sig").alias("sig"))


def entry_rules(lines: DataFrame) -> DataFrame:
    """(row, kind, value, sig): kind @, super, static or main."""
    t = F.col("text")
    kind = F.when(t.startswith("@"), "@").otherwise(F.regexp_extract(t, r"^(super|static|main)", 1))
    rest = F.regexp_replace(t, r"^(?:@|(?:super|static|main)\s*)", "")
    value = F.when(kind == "static", "").otherwise(F.substring_index(rest, "#", 1))
    sig = F.when(kind == "static", rest).when(kind == "super", F.regexp_extract(rest, "#(.*)$", 1)).otherwise("")
    return classified(lines).where("kind = 'entry'").select("row", kind.alias("kind"), value.alias("value"), sig.alias("sig"))


def lines_of(spark, lines: list[str], start: int = 0) -> DataFrame:
    """Lines as a table (row, text), for those bundled here and those of rule providers."""
    return spark.createDataFrame([(start + i, x) for i, x in enumerate(lines)], "row long, text string")


def _small(rules: DataFrame) -> DataFrame:
    """Broadcast if it is no more than BROADCAST_LINES rows."""
    return F.broadcast(rules) if rules.limit(BROADCAST_LINES + 1).count() <= BROADCAST_LINES else rules


def matching_type_rules(sites: DataFrame, rules: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """(edge_id, row, impls): of each call the narrowest rule that matches: by factory and key (keys: edge_id, owner type#method, pos, key,
    key_kind; the first argument with a rule counts), else by type and method, else by type; the first line of those. sites: (edge_id,
    decl_type, sig)."""
    own = sites.select("edge_id", F.col("decl_type").alias("type"), F.substring_index("sig", "(", 1).alias("method"))
    plain = _small(rules.where("key = ''").drop("key", "key_kind"))
    by_type = own.join(plain.withColumnRenamed("method", "asked"), "type").where("asked = '' OR asked = method")
    rows = by_type.select("edge_id", F.struct(F.when(F.col("asked") != "", 1).otherwise(2).alias("width"), F.lit(0).alias("pos"), "row", "impls").alias("r"))
    if keys is not None:
        made = _small(rules.where("key <> ''").withColumn("owner", F.concat_ws("#", "type", "method")).select("owner", "key", "key_kind", "row", "impls"))
        rows = rows.unionByName(keys.join(made, ["owner", "key", "key_kind"]).select("edge_id", F.struct(F.lit(0).alias("width"), F.col("pos").cast("int").alias("pos"), "row", "impls").alias("r")))
    return rows.groupBy("edge_id").agg(F.min("r").alias("r")).select("edge_id", "r.row", "r.impls")


def rule_targets(matched: DataFrame, sites: DataFrame, chosen: DataFrame) -> DataFrame:
    """(edge_id, label, target, row): bodies chosen for the types that the matching rules name. chosen: (type, callee_type, sig, impl). A
    rule none of whose types has a body decides nothing."""
    named = matched.join(sites.select("edge_id", "decl_type", "sig"), "edge_id").select("edge_id", "row", "decl_type", "sig", F.explode("impls").alias("type"))
    body = chosen.select("type", F.col("callee_type").alias("decl_type"), "sig", "impl")
    return named.join(body, ["type", "decl_type", "sig"]).select("edge_id", F.lit("CALL_RULE").alias("label"), F.col("impl").alias("target"), "row").distinct()


def callback_edges(sites: DataFrame, args: DataFrame, rules: DataFrame, bodies: DataFrame, lambdas: DataFrame | None = None) -> DataFrame:
    """(edge_id, caller, callee, sig, label, row): what calls call back. args: (edge_id, place r/a/c, index, type) of values whose type is
    known; bodies: (type, sig, impl) by signature. lambdas: (edge_id, place, index, target, sig) of values that are functions."""
    s = sites.select("edge_id", "caller", F.concat_ws("#", "decl_type", "sig").alias("callee_key"))
    asked = s.join(_small(rules).withColumnRenamed("callee", "callee_key").withColumnRenamed("sig", "back"), "callee_key")
    place = (F.col("v.place") == F.col("q.place")) & (F.col("q.index").isNull() | (F.col("q.index") == -1) | (F.col("q.index") == F.col("v.index")))
    same = F.col("v.edge_id") == F.col("q.edge_id")
    typed = asked.alias("q").join(args.alias("v"), same & place).select("q.edge_id", "caller", "back", "row", "v.type")
    out = typed.join(bodies.select("type", F.col("sig").alias("back"), "impl"), ["type", "back"]).select("edge_id", "caller", F.col("impl").alias("callee"), F.col("back").alias("sig"), "row")
    if lambdas is not None:
        own = asked.alias("q").join(lambdas.alias("v"), same & place).select("q.edge_id", "caller", F.col("target").alias("callee"), "v.sig", "row")
        out = out.unionByName(own)
    return out.groupBy("edge_id", "caller", "callee", "sig").agg(F.min("row").alias("row")).withColumn("label", F.lit("CALLBACK"))


def framework_entries(methods: DataFrame, supers: DataFrame, rules: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """(type, sig, reason, row): methods with a body that a rule says a framework calls, by the first such rule. methods: (type, sig, mods,
    annotations array, has_body); supers: (sub, sup) of all supertypes, libraries' too; overrides: (type, sig, of_type, of_sig), for
    methods that override a rule's declaration under another signature."""
    m = methods.where("has_body").select("type", "sig", "mods", "annotations")
    r = _small(rules)
    simple = F.regexp_replace("value", r"^.*[.$]", "")
    by_note = m.select("type", "sig", F.explode("annotations").alias("value")).withColumn("value", F.regexp_replace("value", "=.*$", "")).join(r.where("kind = '@'").drop("sig"), "value").select("type", "sig", F.concat(F.lit("@"), simple).alias("reason"), "row")
    by_static = m.where(has("mods", "static") & has("mods", "public")).join(r.where("kind = 'static'").drop("kind"), "sig").select("type", "sig", F.concat(F.lit("static "), "sig").alias("reason"), "row")
    launch = m.where(F.col("sig").isin(LAUNCH) & ~has("mods", "private")).withColumn("kind", F.lit("main")).join(r.where("kind = 'main'").select("kind", "row"), "kind")
    by_main = launch.select("type", "sig", F.when(has("mods", "static"), F.concat(F.lit("static "), "sig")).otherwise(F.col("sig")).alias("reason"), "row")
    wanted = r.where("kind = 'super'").select(F.col("value").alias("sup"), F.col("sig").alias("asked"), "row")
    what = F.concat(F.regexp_replace("sup", r"^.*[.$]", ""), F.lit("#"), F.col("asked"))
    by_super = m.join(wanted, m.sig == wanted.asked).join(supers.select(F.col("sub").alias("type"), "sup").distinct(), ["type", "sup"], "left_semi").select("type", "sig", what.alias("reason"), "row")
    out = by_note.unionByName(by_static).unionByName(by_main).unionByName(by_super)
    if overrides is not None:
        tied = overrides.select("type", "sig", F.col("of_type").alias("sup"), F.col("of_sig").alias("asked")).join(wanted, ["sup", "asked"]).join(m, ["type", "sig"], "left_semi")
        out = out.unionByName(tied.select("type", "sig", what.alias("reason"), "row"))
    return out.groupBy("type", "sig").agg(F.min(F.struct("row", "reason")).alias("r")).select("type", "sig", "r.reason", "r.row")


def full_names(simple: DataFrame, types: DataFrame) -> DataFrame:
    """(name, type, n): the one type with that simple name; a name of several (n > 1) or none has a null type. A name with a dot is taken
    as it is. simple: (name); types: (type)."""
    known = types.select("type").distinct().withColumn("name", F.regexp_replace("type", r"^.*[.$]", "")).groupBy("name").agg(F.count("*").alias("n"), F.min("type").alias("only"))
    got = simple.select("name").distinct().join(known, "name", "left")
    dotted = F.instr("name", ".") > 0
    return got.select("name", F.when(dotted, F.col("name")).when(F.col("n") == 1, F.col("only")).alias("type"), F.when(dotted, F.lit(1)).otherwise(F.coalesce("n", F.lit(0))).cast("long").alias("n"))


def usage(rules: DataFrame, reached: DataFrame, applied: DataFrame) -> DataFrame:
    """(row, usage): APPLIED, REACHED (the left side matched a call, the right side gave nothing) or UNUSED of each rule (row)."""
    hit = applied.select("row").distinct().withColumn("a", F.lit(True))
    met = reached.select("row").distinct().withColumn("m", F.lit(True))
    got = rules.select("row").distinct().join(hit, "row", "left").join(met, "row", "left")
    return got.select("row", F.when(F.col("a"), "APPLIED").when(F.col("m"), "REACHED").otherwise("UNUSED").alias("usage"))


def factory_keys(receivers: DataFrame, nodes: DataFrame, args: DataFrame) -> DataFrame:
    """(edge_id, owner, pos, key, key_kind): what factories were given, for calls on their results, in the order of arguments. receivers:
    (edge_id, node); nodes: (node, kind, value) of which M are results of a method key; args: (node, pos, arg). Keys are literals (L),
    constants (V) and classes (K)."""
    made = receivers.join(nodes.where("kind = 'M'").select("node", F.substring_index("value", "(", 1).alias("owner")), "node")
    given = nodes.where("kind IN ('L', 'V', 'K')").select(F.col("node").alias("arg"), F.col("value").alias("key"), F.col("kind").alias("key_kind"))
    return made.join(args, "node").join(given, "arg").select("edge_id", "owner", "pos", "key", "key_kind")


def suggestions(calls: DataFrame, most_listed: int = 200) -> DataFrame:
    """(rule, sites, example, candidates): left sides of rules that would decide open calls, by the number of distinct sites, then by name.
    calls: (rule, file, line, candidates array); of each rule the first site and all candidates, `most_listed` of them listed."""
    site = F.struct("file", "line")
    by = calls.groupBy("rule").agg(F.countDistinct(site).alias("sites"), F.min(site).alias("first"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("candidates")))).alias("candidates"))
    return by.select("rule", "sites", F.concat_ws(":", "first.file", "first.line").alias("example"), F.slice("candidates", 1, most_listed).alias("candidates")).orderBy(F.desc("sites"), "rule")
