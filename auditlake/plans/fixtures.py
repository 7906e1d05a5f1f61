"""Targets derived from the given tables, as SQL text both engines read.

Credential-shaped text is put together from parts, so that none stands here.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions.session import shared_path
from auditlake.sources.tables import targets_from_table, union_targets

DOCKER_PATH = """concat('svc/', CAST(p_partkey AS STRING), CASE p_partkey % 3
 WHEN 0 THEN '/Dockerfile' WHEN 1 THEN '/Dockerfile.prod' ELSE '/app.dockerfile' END)"""

DOCKER_CONTENT = """concat('FROM ', CASE p_partkey % 4 WHEN 0 THEN 'ubuntu' WHEN 1 THEN 'nginx:latest'
  WHEN 2 THEN 'alpine:3.20' ELSE 'scratch' END, chr(10),
 CASE p_partkey % 5 WHEN 0 THEN concat('ADD ./src /app', chr(10))
  WHEN 1 THEN concat('ADD https://example.com/a.tgz /app', chr(10)) ELSE '' END,
 CASE p_partkey % 7 WHEN 0 THEN concat('ENV DB_PASSWORD=x', chr(10))
  WHEN 1 THEN concat('ENV MODE=prod', chr(10)) ELSE '' END,
 CASE p_partkey % 6 WHEN 0 THEN concat('RUN apt-get install -y curl', chr(10))
  WHEN 1 THEN concat('RUN apt-get install --no-install-recommends a && apt-get clean', chr(10))
  WHEN 2 THEN concat('RUN curl -s https://example.com/i | sh', chr(10))
  WHEN 3 THEN concat('RUN sudo make', chr(13), chr(10)) ELSE '' END,
 'EXPOSE ', CAST(p_size * 40 AS STRING), chr(10),
 CASE p_partkey % 8 WHEN 0 THEN concat('USER root', chr(10)) WHEN 1 THEN ''
  ELSE concat('USER app', chr(10)) END,
 CASE WHEN p_partkey % 9 = 0 THEN concat('HEALTHCHECK CMD true', chr(10)) ELSE '' END)"""

K8S_PATH = """concat('k8s/', CAST(p_partkey AS STRING),
 CASE WHEN p_partkey % 2 = 0 THEN '.yaml' ELSE '.yml' END)"""

K8S_CONTENT = """concat('apiVersion: v1', chr(10), 'kind: ',
 CASE WHEN p_partkey % 3 = 0 THEN 'Deployment' ELSE 'Pod' END, chr(10), 'spec:', chr(10),
 CASE p_partkey % 5 WHEN 0 THEN concat('  hostNetwork: true', chr(10))
  WHEN 1 THEN concat('  hostPID: true', chr(10)) WHEN 2 THEN concat('  hostIPC: true', chr(10))
  WHEN 3 THEN concat('  serviceAccountName: default', chr(10)) ELSE '' END,
 '  containers:', chr(10), '  - image: ',
 CASE WHEN p_partkey % 4 = 0 THEN 'app:latest' ELSE 'app:1' END, chr(10),
 CASE WHEN p_partkey % 7 = 0 THEN concat('    resources: {limits: {cpu: 1}}', chr(10)) ELSE '' END,
 CASE WHEN p_partkey % 6 = 0 THEN '' ELSE concat('    securityContext:', chr(10),
  '      runAsUser: ', CASE WHEN p_partkey % 8 = 1 THEN '0' ELSE '1000' END, chr(10)) END,
 CASE p_partkey % 9 WHEN 1 THEN concat('      privileged: true', chr(10))
  WHEN 2 THEN concat('      allowPrivilegeEscalation: true', chr(10))
  WHEN 3 THEN concat('      readOnlyRootFilesystem: false', chr(10))
  WHEN 4 THEN concat('      procMount: Unmasked', chr(10))
  WHEN 5 THEN concat('      capabilities: {add: [SYS_ADMIN]}', chr(10))
  WHEN 6 THEN concat('      capabilities:', chr(10), '        add:', chr(10),
   '        - SYS_ADMIN', chr(10))
  WHEN 7 THEN concat('      runAsNonRoot: true', chr(10)) ELSE '' END,
 CASE p_partkey % 10 WHEN 1 THEN concat('    env: [{valueFrom: {secretKeyRef: {name: a}}}]', chr(10))
  WHEN 2 THEN concat('  volumes: [{hostPath: {path: /}}]', chr(10))
  WHEN 3 THEN concat('    env:', chr(10), '    - name: A', chr(10), '      valueFrom:', chr(10),
   '        secretKeyRef: {name: a}', chr(10)) ELSE '' END,
 CASE p_partkey % 7 WHEN 1 THEN concat('  - image: side:1', chr(10), '    securityContext:', chr(10),
   '      capabilities:', chr(10), '        add:', chr(10), '        - CHOWN', chr(10),
   '        - NET_ADMIN', chr(10))
  WHEN 2 THEN concat('  - image: side:2', chr(10), '    securityContext:', chr(10),
   '      capabilities:', chr(10), '        drop: [ALL]', chr(10),
   '  - image: side:3', chr(10), '    securityContext:', chr(10),
   '      capabilities:', chr(10), '        add: [NET_BIND_SERVICE]', chr(10),
   '        drop: [ALL]', chr(10))
  WHEN 3 THEN concat('  - image: side:4', chr(10), '    env:', chr(10), '    - name: B', chr(10),
   '      value: x', chr(10), '    - name: C', chr(10), '      valueFrom:', chr(10),
   '        secretKeyRef: {name: b}', chr(10))
  WHEN 4 THEN concat('  - image: side:5', chr(10), '    env:', chr(10), '    - name: D', chr(10),
   '      valueFrom:', chr(10), '        configMapKeyRef: {name: c}', chr(10)) ELSE '' END)"""

SECRET_PATH = "concat('cfg/', CAST(c_custkey AS STRING), '.conf')"

_HASH = "md5(CAST(c_custkey AS STRING))"
SECRET_CONTENT = """concat('# app', chr(10), CASE c_custkey % 20
 WHEN 0 THEN concat('id=AK', 'IA', upper(substring(h,1,16)))
 WHEN 1 THEN concat('aws_sec', 'ret = "', h, substring(h,1,8), '"')
 WHEN 2 THEN concat('t=gh', 'p_', h, substring(h,1,4))
 WHEN 3 THEN concat('t=gh', 'o_', h, substring(h,1,4))
 WHEN 4 THEN concat('t=gh', 's_', h, substring(h,1,4))
 WHEN 5 THEN concat('k=sk', '_live_', substring(h,1,24))
 WHEN 6 THEN concat('k=AI', 'za', h, substring(h,1,3))
 WHEN 7 THEN concat('k=GOC', 'SPX-', substring(h,1,28))
 WHEN 8 THEN concat('k=xo', 'xb-1234567890-1234567890-', substring(h,1,24))
 WHEN 9 THEN concat('u=https://hooks.', 'slack.com/services/T0A/B0B/', substring(h,1,24))
 WHEN 10 THEN concat('-----BEGIN RSA ', 'PRIVATE KEY-----')
 WHEN 11 THEN concat('-----BEGIN OPENSSH ', 'PRIVATE KEY-----')
 WHEN 12 THEN concat('j=ey', 'J', h, '.ey', 'J', h, '.', h)
 WHEN 13 THEN concat('api_', 'key: "', substring(h,1,20), '"')
 WHEN 14 THEN concat('pass', 'word = "', substring(h,1,12), '"')
 WHEN 15 THEN concat('dsn=postgres', '://app:', substring(h,1,8), '@db.example.com/x')
 WHEN 16 THEN concat('k=S', 'K', h)
 WHEN 17 THEN concat('k=S', 'G.', substring(h,1,22), '.', h, substring(h,1,11))
 WHEN 18 THEN concat('k=np', 'm_', h, substring(h,1,4))
 ELSE concat('k=M', substring(h,1,23), '.', substring(h,1,6), '.', substring(h,1,27)) END,
 CASE WHEN c_custkey % 40 = 12 THEN ' # example' ELSE '' END, chr(10))""".replace(
    "h,", f"{_HASH},"
).replace(", h)", f", {_HASH})").replace("'K', h", f"'K', {_HASH}")

DOCUMENT_PATH = "concat('doc/', CAST(doc_id AS STRING))"
PAGE_PATH = "concat('page/', CAST(page_id AS STRING))"
CONVERSATION_PATH = "concat('conv/', CAST(conv_id AS STRING), '/', CAST(turn AS STRING))"

# A repository-like path for each document, for the path operators.
REPO_PATH = """concat('repo', CAST(doc_id % 50 AS STRING), '/', CASE doc_id % 8
  WHEN 0 THEN 'node_modules/' WHEN 1 THEN '.git/' WHEN 2 THEN 'src/' WHEN 3 THEN 'srcfoo/'
  WHEN 4 THEN 'test/unit/' WHEN 5 THEN 'sub/vendor/' ELSE '' END,
 lang, '/', CAST(doc_id AS STRING), CASE doc_id % 9
  WHEN 0 THEN '.PNG' WHEN 1 THEN '.min.js' WHEN 2 THEN '.go' WHEN 3 THEN '.lock'
  WHEN 4 THEN '.py' WHEN 5 THEN '' WHEN 6 THEN '.yaml' WHEN 7 THEN '.tar.gz' ELSE '.md' END)"""

# Dockerfiles whose second line has 65,535 or 65,536 bytes, and one short one.
LONG_PATH = "concat('long/', CAST(s_suppkey AS STRING), '/Dockerfile')"
LONG_CONTENT = """concat('FROM ubuntu', chr(10), '#', repeat('x', CASE s_suppkey % 3
 WHEN 0 THEN 65535 WHEN 1 THEN 65534 ELSE 10 END), chr(10), 'USER root', chr(10))"""


# A page with its address, and turns of which some quote a token or a password.
PAGE_CONTENT = "concat(url, chr(10), html)"
_TURN = "conv_id * 31 + turn * 7"
CONVERSATION_CONTENT = f"""concat(text, CASE WHEN ({_TURN}) % 11 = 0
 THEN concat(chr(10), 'use gh', 'p_', substring(concat(md5(CAST(conv_id AS STRING)),
  md5(CAST(turn AS STRING))), 1, 36))
 WHEN ({_TURN}) % 13 = 0 THEN concat(chr(10), 'pass', 'word = "', substring(md5(CAST(conv_id AS STRING)),
  1, 12), '"') ELSE '' END)"""

# The columns the targets are made of.
COLUMNS = {
    "part": ("p_partkey", "p_size"),
    "customer": ("c_custkey",),
    "supplier": ("s_suppkey",),
    "documents": ("doc_id", "lang", "text"),
    "pages": ("page_id", "url", "html"),
    "conversations": ("conv_id", "turn", "text"),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# A session may ask for its input in so many partitions, where a file has fewer row groups than there
# are cores; by default texts are read as they lie, without a shuffle.
PARTITIONS = "spark.auditlake.partitions"
# Tables whose rows are keys that texts are made of: a few MB of them hold the work of many tasks.
KEYS_ONLY = ("part", "customer", "supplier")
# Bytes of keys, as Spark rates the columns, from which dealing them is worth an exchange: below are some hundred rows.
DEALT_FROM = 3 * 1024


def rows_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The columns targets are made of; keys alone, if not few, are dealt to two tasks a core, before they become texts."""
    rows = table(spark, sf_dir, name).select(*COLUMNS[name])
    wanted = spark.conf.get(PARTITIONS, None)
    if wanted is None and name in KEYS_ONLY and rows._jdf.queryExecution().analyzed().stats().sizeInBytes() >= DEALT_FROM:
        wanted = 2 * spark.sparkContext.defaultParallelism
    return rows.repartition(int(wanted)) if wanted else rows


def dockerfiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return targets_from_table(rows_of(spark, sf_dir, "part"), DOCKER_PATH, DOCKER_CONTENT)


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return targets_from_table(rows_of(spark, sf_dir, "part"), K8S_PATH, K8S_CONTENT)


def configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return targets_from_table(rows_of(spark, sf_dir, "customer"), SECRET_PATH, SECRET_CONTENT)


def long_dockerfiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return targets_from_table(rows_of(spark, sf_dir, "supplier"), LONG_PATH, LONG_CONTENT)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return targets_from_table(rows_of(spark, sf_dir, "documents"), DOCUMENT_PATH, "text")


def repository(spark: SparkSession, sf_dir: str) -> DataFrame:
    return targets_from_table(rows_of(spark, sf_dir, "documents"), REPO_PATH, "text")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rows_of(spark, sf_dir, "pages")
    return targets_from_table(rows, PAGE_PATH, PAGE_CONTENT, unescape_html=True)


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rows_of(spark, sf_dir, "conversations")
    return targets_from_table(rows, CONVERSATION_PATH, CONVERSATION_CONTENT)


def everything(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All derived and given targets together."""
    return union_targets(
        dockerfiles(spark, sf_dir),
        manifests(spark, sf_dir),
        configs(spark, sf_dir),
        long_dockerfiles(spark, sf_dir),
        documents(spark, sf_dir),
        pages(spark, sf_dir),
        conversations(spark, sf_dir),
    )


# A folder of very many files, a chain of sixty folders, and folders that globs cut off.
WIDE_FILE = "concat('wide/', CAST(doc_id AS STRING), '.txt')"
DEEP_FILE = """concat('deep/', array_join(transform(sequence(0, CAST(c_custkey % 60 AS INT)), i -> CAST(i AS STRING)), '/'),
 '/c', CAST(c_custkey AS STRING), '.conf')"""
OLD_FILE = "concat('old', CAST(c_custkey % 7 AS STRING), '/skip/c', CAST(c_custkey AS STRING), '.conf')"
OTHER_FILE = "concat('other/c', CAST(c_custkey AS STRING), '.conf')"


# Folders a task knows to be there while it writes files.
FOLDERS = 4096


def write_files(files: DataFrame, root: str) -> int:
    """Write rows ``(path, content)`` as files below a root all executors reach; how many there are.

    With ``also``, an array of paths, each row's content stands under those as well: in folders of a mounted
    path as further names of the one file, which take no inode or block each, else as files of their own.
    """
    named = "also" in files.columns

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, top = fs.FileSystem.from_uri(root)
        made = lru_cache(FOLDERS)(store.create_dir)
        links = isinstance(store, fs.LocalFileSystem)

        def write(path: str, body: bytes) -> None:
            with store.open_output_stream(f"{top}/{path}") as out:
                out.write(body)

        def name(first: str, path: str, body: bytes) -> None:
            try:
                if links:
                    return os.link(f"{top}/{first}", f"{top}/{path}")
            except OSError:  # a file is there, has too many names, or the mount knows no further names
                pass
            write(path, body)

        for batch in batches:
            written = 0
            for path, content, more in zip(batch["path"], batch["content"], batch["also"] if named else repeat(())):
                body = (content or "").encode()
                made(f"{top}/{path.rpartition('/')[0]}")
                write(path, body)
                for other in more:
                    made(f"{top}/{other.rpartition('/')[0]}")
                    name(path, other, body)
                written += 1 + len(more)
            yield pd.DataFrame({"files": [written]})

    columns = ("path", "content", "also") if named else ("path", "content")
    written = files.select(*columns).mapInPandas(put, "files bigint")
    return written.agg(F.sum("files")).first()[0] or 0


def file_tree(spark: SparkSession, sf_dir: str) -> str:
    """Every document and, three times, every customer's text under a name of its own; the root's address."""
    root = shared_path(spark, "tree")
    customers, texts = rows_of(spark, sf_dir, "customer"), rows_of(spark, sf_dir, "documents")
    files = texts.selectExpr(f"{WIDE_FILE} AS path", "text AS content", "CAST(array() AS array<string>) AS also")
    thrice = customers.selectExpr(
        f"{DEEP_FILE} AS path", f"{SECRET_CONTENT} AS content", f"array({OLD_FILE}, {OTHER_FILE}) AS also"
    )
    write_files(files.union(thrice), root)
    return root
