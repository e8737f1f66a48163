"""Tree and crosswalk queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortry.catalog.book import Book, with_views
from cohortry.operators import hierarchy as H
from cohortry.operators.relational import unmatched
from cohortry.plans import adherence as A
from cohortry.sources import views as V

BOOK = Book()
ROOTS = (2, 3)

BELOW = """, below AS (
    SELECT a.* FROM tree a JOIN tree r ON a.parent_id = r.node_id WHERE r.node_id IN (2, 3) AND a.level = r.level + 1
    UNION ALL
    SELECT a.* FROM tree a JOIN below b ON a.parent_id = b.node_id WHERE a.level = b.level + 1)
"""


@BOOK.add("tree_roots", with_views("tree") + " SELECT * FROM tree WHERE parent_id = 0")
def tree_roots(spark, folder):
    return H.roots(V.tree(spark, folder))


@BOOK.add("tree_children", with_views("tree") + " SELECT * FROM tree WHERE parent_id IN (1, 101)")
def tree_children(spark, folder):
    return H.children(V.tree(spark, folder), (1, 101))


@BOOK.add("parent_child", with_views("tree") + " SELECT a.*, b.node_name AS parent_name, b.level AS parent_level FROM tree a JOIN tree b ON a.parent_id = b.node_id")
def parent_child(spark, folder):
    return H.parent_child(V.tree(spark, folder))


@BOOK.add("descendants", with_views("tree") + BELOW + "SELECT * FROM below")
def descendants(spark, folder):
    return H.descendants(V.tree(spark, folder), ROOTS)


@BOOK.add("codes_per_class", with_views("tree", "code_map") + BELOW + """
SELECT b.*, n_codes FROM below b JOIN
  (SELECT node_id, COUNT(code) AS n_codes FROM code_map WHERE common_use = 1 AND default_use = 1 GROUP BY node_id) c ON b.node_id = c.node_id""")
def codes_per_class(spark, folder):
    return H.codes_per_class(V.tree(spark, folder), V.code_map(spark, folder), ROOTS)


@BOOK.add("build_crosswalk", with_views("tree", "code_map") + BELOW + """
SELECT DISTINCT b.node_id, b.node_name, c.code FROM below b JOIN code_map c ON b.node_id = c.node_id
WHERE common_use = 1 AND default_use = 1 AND b.parent_id NOT IN (101, 106) AND b.node_id NOT IN (1003, 1010)""")
def build_crosswalk(spark, folder):
    return H.build_crosswalk(V.tree(spark, folder), V.code_map(spark, folder), ROOTS, not_parents=(101, 106), not_nodes=(1003, 1010))


@BOOK.add("leaf_codes", with_views("tree", "code_map") + """
SELECT t.*, c.code FROM tree t JOIN code_map c ON t.node_id = c.node_id WHERE common_use = 1 AND default_use = 1 AND is_leaf = 1""")
def leaf_codes(spark, folder):
    return H.leaf_codes(V.tree(spark, folder), V.code_map(spark, folder))


@BOOK.add("code_coverage", with_views("claims", "code_map") + """, known AS (SELECT DISTINCT code FROM code_map WHERE common_use = 1)
SELECT (SELECT COUNT(DISTINCT code) FROM claims) AS n_used, (SELECT COUNT(*) FROM known) AS n_known,
       (SELECT COUNT(DISTINCT code) FROM claims WHERE code NOT IN (SELECT code FROM known)) AS n_unmapped""")
def code_coverage(spark, folder):
    return H.coverage(V.claims(spark, folder), V.code_map(spark, folder).where(F.col("common_use") == 1))


@BOOK.add("unmapped_codes", with_views("claims", "code_map") + " SELECT DISTINCT code, lob FROM claims WHERE code NOT IN (SELECT code FROM code_map WHERE default_use = 1)")
def unmapped_codes(spark, folder):
    used = V.claims(spark, folder).select("code", "lob").distinct()
    return unmatched(used, V.code_map(spark, folder).where(F.col("default_use") == 1), ["code"])


@BOOK.add("refills_from_tree", with_views("claims", "tree", "code_map") + BELOW + """, xw AS (
  SELECT DISTINCT b.node_id AS class_id, c.code FROM below b JOIN code_map c ON b.node_id = c.node_id WHERE common_use = 1 AND default_use = 1)
SELECT member_id, class_id, service_date, MAX(days_supply) AS days_supply FROM claims JOIN xw USING (code) GROUP BY member_id, class_id, service_date""")
def refills_from_tree(spark, folder):
    xwalk = H.build_crosswalk(V.tree(spark, folder), V.code_map(spark, folder), ROOTS).withColumnRenamed("node_id", "class_id")
    return A.refills_of(V.claims(spark, folder), [xwalk])
