"""Lock files of every shape, made of customers' keys."""

from __future__ import annotations

from stratalens.plans.adapters import view
from stratalens.plans.outline_queries import source_texts
from stratalens.registry import query
from stratalens.sources import locks

PNPM = (
    ("true", "# a lock"), ("c_custkey % 2 = 0", "lockfileVersion: ^9.0^"), ("c_custkey % 2 = 1", "lockfileVersion: 5.4"), ("c_custkey % 2 = 0", "importers:"), ("c_custkey % 2 = 0", "  .:"), ("true", "INdependencies:"),
    ("c_custkey % 2 = 0", "      ^@x/y^:"), ("c_custkey % 2 = 0", "        specifier: ^1.0.0"), ("c_custkey % 2 = 0", "        version: 1.2.N(react@18.3.1)"), ("c_custkey % 2 = 1", "  left: 1.2.N_react@18.3.1"), ("c_custkey % 2 = 1", "  other: /real/3.0.0"), ("true", "INdevDependencies:"),
    ("c_custkey % 6 = 0", "      alias:"), ("c_custkey % 6 = 0", "        specifier: npm:real@^2"), ("c_custkey % 6 = 0", "        version: real@2.0.1"), ("c_custkey % 2 = 0", "      linked:"), ("c_custkey % 2 = 0", "        version: link:../b"), ("c_custkey % 2 = 1", "  linked: link:../b # no"),
    ("c_custkey % 10 = 0", "  packages/b:"), ("c_custkey % 10 = 0", "    dependencies:"), ("c_custkey % 10 = 0", "      deep:"), ("c_custkey % 10 = 0", "        version: 4.0.0-rc.1"),
    ("true", ""), ("true", "packages:"), ("c_custkey % 2 = 0", "  ^@x/y@1.2.N(react@18.3.1)^:"), ("c_custkey % 2 = 0", "    resolution: {integrity: sha512-a}"), ("c_custkey % 2 = 0", "    cpu:"), ("c_custkey % 2 = 0", "      - x64"), ("c_custkey % 2 = 0", "  git@https://x: {}"), ("c_custkey % 2 = 1", "  /@s/left/1.2.N_react@18.3.1:"), ("c_custkey % 2 = 1", "    dev: true"), ("c_custkey % 2 = 1", "  /real/3.0.0:"), ("c_custkey % 2 = 1", "    engines: {node: 1}"), ("c_custkey % 2 = 1", "    dev: false"),
)
BASE = "keys AS (SELECT concat('f', c_custkey) AS path, c_custkey AS k, c_nationkey AS n FROM customer)"


def pnpm(spark, sf):
    # top-level or importer's indentation
    even = [(w, line.replace("IN", "    ")) for w, line in PNPM]
    odd = [(w, line.replace("IN", "")) for w, line in PNPM]
    a, b = source_texts(spark, sf, even), source_texts(spark, sf, odd)
    return a.where("cast(substr(path, 2) as long) % 2 = 0").unionAll(b.where("cast(substr(path, 2) as long) % 2 = 1"))


@query("s12_pnpm_importers", f"""
  WITH {BASE} SELECT path, importer, package, name, version FROM keys, LATERAL (VALUES (k % 2 = 0, '', '@x/y', '@x/y', '1.2.' || n), (k % 2 = 1, '', 'left', 'left', '1.2.' || n), (k % 2 = 1, '', 'other', 'real', '3.0.0'), (k % 6 = 0, '', 'alias', 'real', '2.0.1'), (k % 10 = 0, 'packages/b', 'deep', 'deep', '4.0.0-rc.1')) t(present, importer, package, name, version) WHERE present""")  # fmt: skip
def importers(spark, sf):
    return locks.pnpm_importers(pnpm(spark, sf))


@query("s12_pnpm_packages", f"""
  WITH {BASE} SELECT path, name, version, dev FROM keys, LATERAL (VALUES (k % 2 = 0, '@x/y', '1.2.' || n, NULL), (k % 2 = 1, '@s/left', '1.2.' || n, true), (k % 2 = 1, 'real', '3.0.0', false)) t(present, name, version, dev) WHERE present""")  # fmt: skip
def packages(spark, sf):
    return locks.pnpm_packages(pnpm(spark, sf))


BERRY = (
    ("true", "__metadata:"), ("true", "  version: 8"), ("true", ""), ("true", "\"@x/y@npm:~1.0.0, @x/y@npm:~1.N.0\":"), ("true", "  version: 1.2.N"), ("true", "  resolution: \"@x/y@npm:1.2.N\""), ("c_custkey % 3 = 0", "  dependencies:"), ("c_custkey % 3 = 0", "    left: \"npm:~2.0.0\""), ("true", "  languageName: node"),
    ("c_custkey % 3 = 0", "\"left@npm:~2.0.0\":"), ("c_custkey % 3 = 0", "  resolution: \"left@npm:2.0.5\""), ("true", "\"patched@patch:left@npm%3A2\":"), ("true", "  resolution: \"patched@patch:left\""), ("true", "\"root@workspace:.\":"), ("true", "  resolution: \"root@workspace:.\""), ("true", "  dependencies:"), ("true", "    \"@x/y\": \"npm:~1.N.0\""), ("c_custkey % 2 = 0", "    missing: \"npm:*\""),
    ("c_custkey % 4 = 0", "\"b@workspace:packages/b\":"), ("c_custkey % 4 = 0", "  resolution: \"b@workspace:packages/b\""), ("c_custkey % 4 = 0", "  dependencies:"), ("c_custkey % 4 = 0", "    left: \"npm:~2.0.0\""),
)


@query("s12_berry_descriptors", f"""
  WITH {BASE} SELECT path, descriptor, name, version FROM keys, LATERAL (VALUES (true, '@x/y@npm:~1.0.0', '@x/y', '1.2.' || n), (true, '@x/y@npm:~1.' || n || '.0', '@x/y', '1.2.' || n), (k % 3 = 0, 'left@npm:~2.0.0', 'left', '2.0.5')) t(present, descriptor, name, version) WHERE present""")  # fmt: skip
def descriptors(spark, sf):
    return locks.berry_descriptors(source_texts(spark, sf, BERRY))


@query("s12_berry_importers", f"""
  WITH {BASE} SELECT DISTINCT path, importer, package, name, version FROM keys, LATERAL (VALUES (n > 0, '', '@x/y', '@x/y', '1.2.' || n), (k % 12 = 0, 'packages/b', 'left', 'left', '2.0.5'), (n = 0, '', '@x/y', '@x/y', '1.2.0')) t(present, importer, package, name, version) WHERE present""")  # fmt: skip
def berry_importers(spark, sf):
    return locks.berry_importers(source_texts(spark, sf, BERRY)).distinct()  # for nation 0 a head names one descriptor twice


NPM_V1 = """
  SELECT concat('f', CAST(c_custkey AS STRING)) AS path, CASE WHEN c_custkey % 13 = 5 THEN '{ broken' ELSE concat('{"lockfileVersion": 1, "dependencies": {"a": {"version": "1.2.', CAST(c_nationkey AS STRING), '", "dev": ', CASE WHEN c_custkey % 2 = 0 THEN 'true' ELSE 'false' END,
    CASE WHEN c_custkey % 3 = 0 THEN ', "requires": {"b": "^2"}, "dependencies": {"b": {"version": "npm:@r/eal@2.0.0", "dependencies": {"c": {"version": "3.0.0"}, "g": {"version": "git+https://x", "dependencies": {"d": {"version": "4.0.0", "dev": true}}}}}}' ELSE '' END,
    '}, "file": {"version": "1.0.0", "resolved": "file:../x"}, "e": {"version": "5.0.0-rc.1+b"}}}') END AS text FROM customer"""


@query("s12_npm_v1_packages", f"""
  WITH {BASE} SELECT path, package, name, version, dev, depth FROM keys, LATERAL (VALUES (true, 'a', 'a', '1.2.' || n, k % 2 = 0, 0), (true, 'e', 'e', '5.0.0-rc.1+b', false, 0), (k % 3 = 0, 'b', '@r/eal', '2.0.0', false, 1), (k % 3 = 0, 'c', 'c', '3.0.0', false, 2), (k % 3 = 0, 'd', 'd', '4.0.0', true, 3)) t(present, package, name, version, dev, depth)
  WHERE present AND k % 13 <> 5""")  # fmt: skip
def npm_v1(spark, sf):
    return locks.npm_v1_packages(view(spark, sf, NPM_V1))
