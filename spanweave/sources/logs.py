"""Readers for framework logs, each a DataFrame of phases or links between them.

Phases have path, type, parent, start_ns and end_ns; lines are matched with Spark's functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.session import cut
from ..operators.graphs import direct_predecessors

MS = 1_000_000
#: Fixed value: the time stamp of Airflow task logs.
STAMP = r"\[(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d{3})\]"


def read_hosts(spark: SparkSession, path: str) -> DataFrame:
    """alias, host: the first name of a line is the host, all its names stand for it. A name on two lines is an error."""
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", "#.*", "")).alias("line")).filter("line <> ''")
    names = lines.select(F.split("line", r"\s+").alias("names"))
    rows = names.select(F.explode("names").alias("alias"), F.element_at("names", 1).alias("host"))
    found = rows.groupBy("alias").agg(F.count(F.lit(1)).alias("n"), F.min("host").alias("host"))
    return found.withColumn("host", F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("host name on two lines: "), "alias"))).otherwise(F.col("host"))).drop("n")


def _spark_events(spark: SparkSession, path: str) -> DataFrame:
    schema = """Event string, `App ID` string, Timestamp long, `Job ID` long, `Stage IDs` array<long>, `Submission Time` long, `Completion Time` long,
      `Stage ID` long, `Stage Attempt ID` long, `Block Manager ID` struct<`Executor ID`: string, Host: string>,
      `Stage Info` struct<`Stage ID`: long, `Stage Attempt ID`: long, `Submission Time`: long, `Completion Time`: long>,
      `Task Info` struct<`Task ID`: long, Attempt: long, `Launch Time`: long, `Finish Time`: long, Host: string>"""
    events = spark.read.schema(schema).json(path, recursiveFileLookup=True).withColumn("file", F.input_file_name())
    app = events.filter("Event = 'SparkListenerApplicationStart'").select("file", F.col("App ID").alias("app"))
    return events.drop("App ID").join(app, "file")


def read_spark_phases(spark: SparkSession, path: str) -> DataFrame:
    """Applications, jobs, stages and tasks of event logs; a task's host comes along."""
    events = _spark_events(spark, path)
    of = lambda name: events.filter(F.col("Event") == f"SparkListener{name}")
    app_path = F.concat(F.lit("/spark_app[id="), F.col("app"), F.lit("]"))
    row = lambda p, t, parent, s, e, host: [p.alias("path"), F.lit(t).alias("type"), parent.alias("parent"), (s * MS).alias("start_ns"), (e * MS).alias("end_ns"), host.alias("host")]
    no_host = F.lit(None).cast("string")
    driver = of("BlockManagerAdded").filter(F.col("Block Manager ID.Executor ID") == "driver").select("app", F.col("Block Manager ID.Host").alias("host"))
    spans = of("ApplicationStart").select("app", F.col("Timestamp").alias("s")).join(of("ApplicationEnd").select("app", F.col("Timestamp").alias("e")), "app").join(driver, "app", "left")
    apps = spans.select(*row(app_path, "/spark_app", F.lit("/"), F.col("s"), F.col("e"), F.col("host")))
    job_path = F.concat(app_path, F.lit("/job[id="), F.col("Job ID").cast("string"), F.lit("]"))
    starts = of("JobStart").select("app", "Job ID", F.col("Submission Time").alias("s"), "Stage IDs")
    jobs = starts.join(of("JobEnd").select("app", "Job ID", F.col("Completion Time").alias("e")), ["app", "Job ID"])
    job_rows = jobs.select(*row(job_path, "/spark_app/job", app_path, F.col("s"), F.col("e"), no_host))
    owner = jobs.select("app", F.explode("Stage IDs").alias("stage"), "Job ID").groupBy("app", "stage").agg(F.min("Job ID").alias("Job ID"))
    stage_path = F.concat(job_path, F.lit("/stage[attempt="), F.col("attempt").cast("string"), F.lit(",id="), F.col("stage").cast("string"), F.lit("]"))
    info = F.col("Stage Info")
    stages = of("StageCompleted").select("app", info["Stage ID"].alias("stage"), info["Stage Attempt ID"].alias("attempt"), info["Submission Time"].alias("s"), info["Completion Time"].alias("e")).join(owner, ["app", "stage"])
    stage_rows = stages.select(*row(stage_path, "/spark_app/job/stage", job_path, F.col("s"), F.col("e"), no_host))
    task = F.col("Task Info")
    tasks = of("TaskEnd").select("app", F.col("Stage ID").alias("stage"), F.col("Stage Attempt ID").alias("attempt"), task["Task ID"].alias("task"), task["Attempt"].alias("try"), task["Launch Time"].alias("s"), task["Finish Time"].alias("e"), task["Host"].alias("host")).join(owner, ["app", "stage"])
    task_path = F.concat(stage_path, F.lit("/task[attempt="), F.col("try").cast("string"), F.lit(",id="), F.col("task").cast("string"), F.lit("]"))
    task_rows = tasks.select(*row(task_path, "/spark_app/job/stage/task", stage_path, F.col("s"), F.col("e"), F.col("host")))
    return apps.union(job_rows).union(stage_rows).union(task_rows)


def job_dependencies(phases: DataFrame) -> DataFrame:
    """after, path: a job waits for the jobs that ended before it began, those left out that another such job waits for."""
    jobs = phases.filter("type = '/spark_app/job'")
    return direct_predecessors(jobs, "parent", "path", "start_ns", "end_ns").select("after", "path")


def _stamp_ns(column):
    return (F.unix_micros(F.to_timestamp(column, "yyyy-MM-dd HH:mm:ss,SSS")) * 1000).alias("ns")


def _in_order(lines: DataFrame) -> DataFrame:
    """file, at, value: lines with their place in their file, whatever splits it is read in: the split's first byte, then the order inside it."""
    split = F.col("_metadata.file_block_start").alias("split")
    return lines.select(F.input_file_name().alias("file"), F.struct(split, F.monotonically_increasing_id().alias("row")).alias("at"), "value")


def read_airflow_lines(spark: SparkSession, place: str) -> DataFrame:
    """file, dag, run, task, at, line of all task logs; a log without its context lines is left out."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.log").text(place)
    lines = _in_order(lines).withColumnRenamed("value", "line")
    tag = lambda name: F.max(F.when(F.col("line").contains(f"AIRFLOW_CTX_{name}="), F.regexp_extract("line", rf"AIRFLOW_CTX_{name}=(\S+)", 1)))
    named = lines.groupBy("file").agg(tag("DAG_ID").alias("dag"), tag("DAG_RUN_ID").alias("run"), tag("TASK_ID").alias("task"))
    return lines.join(named.filter("dag IS NOT NULL AND run IS NOT NULL AND task IS NOT NULL"), "file")


def airflow_phases(lines: DataFrame) -> DataFrame:
    """One phase per task run, from its first to its last time stamp."""
    stamped = lines.withColumn("stamp", F.regexp_extract("line", STAMP, 1)).filter("stamp <> ''").select("dag", "run", "task", _stamp_ns(F.col("stamp")))
    spans = stamped.groupBy("dag", "run", "task").agg(F.min("ns").alias("start_ns"), F.max("ns").alias("end_ns"))
    parent = F.concat(F.lit("/airflow_dag[id="), F.col("dag"), F.lit("]/run[id="), F.col("run"), F.lit("]"))
    return spans.select(F.concat(parent, F.lit("/task[id="), F.col("task"), F.lit("]")).alias("path"), F.lit("/airflow_dag/run/task").alias("type"), parent.alias("parent"), "start_ns", "end_ns", "dag", "run", "task")


def read_airflow_order(spark: SparkSession, place: str) -> DataFrame:
    """dag, task, after: the edges of indented task trees, one file per DAG; a deeper line comes after the one it hangs from.

    Lines are indented by whole steps, the least indentation of a file. A line hangs from the last line above it that is one level
    less deep: each line is offered to the level below its own, and a level's lines and offers are walked in order once.
    """
    files = spark.read.option("pathGlobFilter", "*.dag").text(place)
    rows = _in_order(files).withColumnRenamed("value", "line").filter(F.col("line").contains("<Task("))
    rows = rows.withColumn("depth", F.length(F.regexp_extract("line", r"^(\s*)", 1))).withColumn("task", F.regexp_extract("line", r"<Task\([^)]*\):\s*([^>]+)>", 1))
    rows = rows.withColumn("dag", F.regexp_extract("file", r"([^/]+)\.dag$", 1))
    step = rows.filter("depth > 0").groupBy("file").agg(F.min("depth").alias("step"))
    rows = rows.join(step, "file").withColumn("level", F.expr("depth div step"))  # a file without a deeper line has no edges
    offers = rows.select("dag", "file", "at", (F.col("level") + 1).alias("level"), F.lit(None).cast("string").alias("task"), F.col("task").alias("offer"))
    both = offers.unionByName(rows.select("dag", "file", "at", "level", "task", F.lit(None).cast("string").alias("offer")))
    over = Window.partitionBy("file", "level").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    tied = both.withColumn("after", F.last("offer", ignorenulls=True).over(over))
    return tied.filter("task IS NOT NULL AND after IS NOT NULL").select("dag", "task", "after").distinct()


def spark_under_airflow(phases: DataFrame, lines: DataFrame) -> DataFrame:
    """phases of Spark with those of an application moved under the Airflow task whose log names it."""
    named = lines.filter(F.lower("line").contains("spark")).select("dag", "run", "task", F.explode(F.regexp_extract_all("line", F.lit(r"(app(?:lication)?-[\d-]+|local-\d+|application_\d+_\d+)"), 1)).alias("app"))
    owner = named.groupBy("app").agg(F.min(F.struct("dag", "run", "task")).alias("o"))
    prefix = F.concat(F.lit("/airflow_dag[id="), F.col("o.dag"), F.lit("]/run[id="), F.col("o.run"), F.lit("]/task[id="), F.col("o.task"), F.lit("]"))
    owner = owner.select("app", prefix.alias("prefix"))
    joined = phases.withColumn("app", F.regexp_extract("path", r"^/spark_app\[id=([^\]]+)\]", 1)).join(owner, "app", "left")
    moved = lambda c: F.when(F.col("prefix").isNull(), F.col(c)).when(F.col(c) == "/", F.col("prefix")).otherwise(F.concat("prefix", c))
    kind = F.when(F.col("prefix").isNull(), F.col("type")).otherwise(F.concat(F.lit("/airflow_dag/run/task"), "type"))
    return joined.withColumns({"path": moved("path"), "parent": moved("parent"), "type": kind}).drop("app", "prefix")


def tensorflow_epochs(lines: DataFrame) -> DataFrame:
    """Epochs in the logs of Airflow tasks that ran TensorFlow: each lasts until the next one begins or the log ends."""
    uses = lines.filter(F.col("line").contains("I tensorflow/")).select("file").distinct()
    stamped = lines.join(uses, "file").withColumn("stamp", F.regexp_extract("line", STAMP, 1)).filter("stamp <> ''").select("file", "dag", "run", "task", "at", "line", _stamp_ns(F.col("stamp")))
    last = stamped.groupBy("file").agg(F.max("ns").alias("last_ns"))
    epochs = stamped.withColumn("epoch", F.regexp_extract("line", r"<stdout>:\s*Epoch (\d+)/\d+", 1)).filter("epoch <> ''")
    over = Window.partitionBy("file").orderBy("at")
    timed = epochs.withColumn("next_ns", F.lead("ns").over(over)).join(last, "file")
    parent = F.concat(F.lit("/airflow_dag[id="), F.col("dag"), F.lit("]/run[id="), F.col("run"), F.lit("]/task[id="), F.col("task"), F.lit("]"))
    return timed.select(F.concat(parent, F.lit("/epoch[id="), F.col("epoch"), F.lit("]")).alias("path"), F.lit("/airflow_dag/run/task/epoch").alias("type"), parent.alias("parent"), F.col("ns").alias("start_ns"), F.coalesce("next_ns", "last_ns").alias("end_ns"))


def read_operation_log(spark: SparkSession, place: str) -> DataFrame:
    """Event records of key=value lines: timestamp, type and the tags as a map."""
    lines = spark.read.text(place).filter(F.col("value").contains("="))
    tags = F.expr(r"str_to_map(regexp_replace(trim(value), '\\s+', ' '), ' ', '=')")
    rows = lines.select(tags.alias("tags"))
    return rows.select(F.col("tags")["timestamp"].cast("long").alias("timestamp"), F.col("tags")["type"].alias("type"), F.map_filter("tags", lambda k, v: ~k.isin("timestamp", "type")).alias("tags"))


def records_to_phases(records: DataFrame, name: str) -> DataFrame:
    """Phases from START and END records that agree in the tag `name`; a record without its partner is left out."""
    rows = records.withColumn("path", F.col("tags")[name])
    at = lambda kind: F.min(F.when(F.col("type") == kind, F.col("timestamp")))
    return rows.groupBy("path").agg(at("START").alias("start_ns"), at("END").alias("end_ns")).filter("start_ns IS NOT NULL AND end_ns IS NOT NULL AND path IS NOT NULL")


def nested_phases(records: DataFrame, stream: list[str], name: str) -> DataFrame:
    """stream, path, depth, start_ns, end_ns: phases from the START and END records (line, timestamp, event, tags) of a stream, whose lines nest and carry no ids.

    The running depth pairs them: the k-th START that opens a depth belongs to the k-th END that closes it. Paths are the names
    (tag `name`) of what is open, numbered inside what they lie in: [n=2] is the second of its name there. An END that closes nothing and a
    START that nothing closes are left out.
    """
    marks = records.filter("event IN ('START', 'END')").select(*stream, "timestamp", "line", "event", F.col("tags")[name].alias("name"))
    marks = marks.withColumn("step", F.when(F.col("event") == "START", 1).otherwise(-1))
    over = Window.partitionBy(*stream).orderBy("timestamp", "line")
    # An END without an open START counts as nothing: the depth is taken over its lowest point so far.
    raw = marks.withColumn("raw", F.sum("step").over(over))
    raw = raw.withColumn("low", F.least(F.lit(0), F.min("raw").over(over))).withColumn("before", F.coalesce(F.lag("low").over(over), F.lit(0)))
    held = raw.filter((F.col("event") == "START") | (F.col("low") == F.col("before")))
    held = held.withColumn("depth", F.col("raw") - F.col("low") + F.when(F.col("event") == "END", 1).otherwise(0))
    kth = Window.partitionBy(*stream, "depth", "event").orderBy("timestamp", "line")
    held = held.withColumn("k", F.row_number().over(kth))
    start = lambda c: F.max(F.when(F.col("event") == "START", F.col(c)))
    pairs = held.groupBy(*stream, "depth", "k").agg(start("name").alias("name"), start("timestamp").alias("start_ns"), start("line").alias("line"), F.max(F.when(F.col("event") == "END", F.col("timestamp"))).alias("end_ns"))
    # What a phase lies in: the last START of each lower depth. Numbers first, then paths from the root down.
    deepest = pairs.agg(F.max("depth")).first()[0] or 0
    known = None
    for depth in range(1, deepest + 1):
        here = pairs.filter(F.col("depth") == depth).withColumns({"parent": F.lit(""), "from": F.col("start_ns")})
        if known is not None:
            both = here.select(*stream, "start_ns", "line", "depth", "k", "name", "end_ns", F.lit(None).cast("string").alias("up")).unionByName(known.select(*stream, "start_ns", "line", F.col("depth") + 1, F.lit(None).cast("int").alias("k"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("long").alias("end_ns"), F.col("path").alias("up")).toDF(*stream, "start_ns", "line", "depth", "k", "name", "end_ns", "up"))
            last = Window.partitionBy(*stream).orderBy("start_ns", "line")
            here = both.withColumn("parent", F.last("up", ignorenulls=True).over(last)).filter("k IS NOT NULL")
        number = F.row_number().over(Window.partitionBy(*stream, "parent", "name").orderBy("start_ns", "line")).cast("string")
        here = here.withColumn("path", F.concat("parent", F.lit("/"), "name", F.lit("[n="), number, F.lit("]")))
        known = cut(here.select(*stream, "path", "depth", "start_ns", "line", "end_ns"))
        out = known if depth == 1 else out.unionByName(known)
    if not deepest:
        return pairs.select(*stream, F.col("name").alias("path"), "depth", "start_ns", "end_ns")
    return out.filter("end_ns IS NOT NULL").drop("line")


def spans_of_parents(phases: DataFrame) -> DataFrame:
    """Spans of the paths that only their children time: from the first child's start to the last one's end."""
    return phases.groupBy(F.col("parent").alias("path")).agg(F.min("start_ns").alias("start_ns"), F.max("end_ns").alias("end_ns"))


def on_hosts(phases: DataFrame, aliases: DataFrame) -> DataFrame:
    """phases with the canonical name of their host; a name without an alias stays as it is."""
    named = aliases.select(F.col("alias").alias("_alias"), F.col("host").alias("_host"))
    return phases.join(named, F.col("host") == F.col("_alias"), "left").withColumn("host", F.coalesce("_host", "host")).drop("_alias", "_host")
