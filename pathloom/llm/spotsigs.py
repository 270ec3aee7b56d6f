"""SpotSigs fingerprints (Theobald et al. 2008), in DataFrame operations only.

Words are runs of letters and digits in lower case. Each common word is an anchor; its signature is the anchor
and the next three content words, common words between them left out. The start of a text is an anchor too, so
a text with a content word has a signature; a chain at the end may be shorter, and one without content words is
none. A fingerprint is the sorted set of the signatures' 32-bit hashes, in hex; likeness is the Jaccard
coefficient of two sets, 1 for two empty ones. The time that a text takes grows with its length, whatever its words.

Null text counts as empty, with the empty fingerprint. Rows that share an id are neighbours in order of a hash
of their texts. An empty table gives no row; a table of one document has it as its own successor. Columns
besides doc_id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import components, cut, partitions

#: Common words of English, German, French and Spanish.
COMMON_WORDS = """
a about after all also an and any are as at be been but by can could do for from had has have he her his how i if in into is it its
more my no not of on one or other our out she so some than that the their them then there these they this to up was we were what when
which who will with would you your
aber als am an auch auf aus bei bin bis das dass dem den der des die du ein eine einem einen einer es er für hat ich ihr im in ist kann
man mit nach nicht noch nur oder sein sich sie sind so um und von vor war was wenn werden wie wir wird zu zum zur
au aux avec ce ces cette dans de des du elle en est et eux il je la le les leur lui mais ne nous on ou par pas plus pour qu que qui sa se
ses son sont sur tout un une vous
al como con de del el ella en entre era es esta este ha hay la las lo los más me mi no nos o para pero por que se si sin sobre son su sus
también un una y ya
""".split()

CHAIN = 3


def let(value: Column, use) -> Column:
    """use(value), where the value is computed once however often, and in whatever lambdas, it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def signatures(text: str, chain: int = CHAIN) -> Column:
    """Sorted distinct 32-bit signature hashes of a text column."""
    common = sorted(set(COMMON_WORDS))
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    words = F.filter(F.split(plain, " "), lambda w: w != "")
    # content words begin a piece; anchors follow, marked, in the piece of the content word before them
    marked = F.transform(words, lambda w: F.concat(F.when(w.isin(common), F.lit("\x01")).otherwise("\x02"), w))
    pieces = F.split(F.concat(F.lit("\x01\x03 "), F.array_join(marked, " ")), "\x02")

    def of(p: Column) -> Column:
        def spots(piece, k):
            anchors = F.array_distinct(F.filter(F.split(piece, " "), lambda w: F.startswith(w, F.lit("\x01"))))
            content = [F.substring_index(F.get(p, k + j), " ", 1) for j in range(1, chain + 1)]  # null beyond the end
            found = F.transform(anchors, lambda a: F.hash(F.concat_ws(" ", a, *content)))
            return F.when(k + 1 < F.size(p), found).otherwise(F.array().cast("array<int>"))

        return F.flatten(F.transform(p, spots))

    return F.array_sort(F.array_distinct(let(pieces, of)))


def fingerprint(sigs: str | Column) -> Column:
    sigs = F.col(sigs) if isinstance(sigs, str) else sigs
    return F.array_join(F.transform(sigs, lambda s: F.lpad(F.lower(F.hex(s.cast("long").bitwiseAND(0xFFFFFFFF))), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / (F.size(a) + F.size(b) - both))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, sigs with next_text, next_sigs of the next document by id, after the last the first.

    Ids are cut at their quantiles into ranges, each a window of its own; the first document of the next range
    that has any joins each range as its last, so no window spans the table.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = 2 * partitions(spark)
    bounds = docs.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 10_000)).first()[0] or []
    bounds = sorted(set(bounds))
    edges = F.array(*map(F.lit, bounds)) if bounds else F.array().cast("array<long>")
    docs = docs.withColumn("part", F.coalesce(F.size(F.filter(edges, lambda b: b <= F.col("doc_id"))), F.lit(0)) if bounds else F.lit(0))
    order = F.struct("doc_id", F.xxhash64("text").alias("h"))
    heads = cut(docs.groupBy("part").agg(F.min_by(F.struct("doc_id", "text"), order).alias("head")))  # one row a range
    ring = Window.orderBy(F.col("part").desc())
    before = heads.select("head", F.coalesce(F.lead("part").over(ring), F.max("part").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("part"))
    guests = before.select(F.col("head.doc_id").alias("doc_id"), F.col("head.text").alias("text"), "part", F.lit(True).alias("guest"))
    rows = docs.withColumn("guest", F.lit(False)).unionByName(guests).withColumn("sigs", signatures("text"))
    following = Window.partitionBy("part").orderBy("guest", "doc_id", F.xxhash64("text"))
    rows = rows.withColumns({"next_text": F.lead("text").over(following), "next_sigs": F.lead("sigs").over(following)})
    return rows.where(~F.col("guest")).select("doc_id", "text", "sigs", "next_text", "next_sigs")


def spotsigs_digest(docs: DataFrame) -> DataFrame:
    rows = with_next(docs).withColumn("n_chars", F.length("text").cast("long"))
    k = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - k).cast("int")), F.substring("next_text", F.lit(1), k))
    rows = rows.withColumn("edited", edited).withColumn("edited_sigs", signatures("edited"))
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint("sigs").alias("fingerprint"), fingerprint("edited_sigs").alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"), likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
    )


def near_duplicates(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """doc_id, class_id, component_id: documents of equal fingerprints form a class, named by its smallest id; classes whose likeness reaches `threshold` link.

    Sets are partitioned by length: a set of n only meets sets of n to n / threshold. Within that, the sets
    share one of their rarest signatures, the first n - ceil(threshold * n) + 1 of each. The first class on the list
    of such a signature is compared with the others; then those on a list that aren't of one component yet are
    compared among themselves, so a list of copies of one text costs no more than its length. Pairs are compared
    once. Documents without a content word link with nothing but their equals.
    """
    sets = docs.select("doc_id", signatures("text").alias("sigs"))
    classes = cut(sets.groupBy("sigs").agg(F.min("doc_id").alias("class_id")))
    member = sets.withColumn("key", F.sha2(fingerprint("sigs"), 256)).join(classes.select(F.sha2(fingerprint("sigs"), 256).alias("key"), "class_id"), "key").select("doc_id", "class_id")
    sized = classes.withColumn("n", F.size("sigs")).where("n > 0")
    post = sized.select("class_id", "n", F.explode("sigs").alias("sig"))
    common = post.groupBy("sig").agg(F.count("*").alias("df"))
    place = F.row_number().over(Window.partitionBy("class_id").orderBy("df", "sig"))
    first = post.join(common, "sig").where("df > 1 or n = 1").withColumn("place", place + 0)
    lone = post.join(common, "sig").where("df = 1").groupBy("class_id").agg(F.count("*").alias("lone"))
    first = first.join(lone, "class_id", "left").withColumn("place", F.col("place") + F.coalesce("lone", F.lit(0)))
    posts = cut(first.where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * threshold) + 1).select("sig", "class_id", "n"))

    def linked(pairs: DataFrame) -> DataFrame:
        pairs = pairs.where(F.least("na", "nb") >= F.greatest("na", "nb") * threshold).select("a", "b").distinct()
        pairs = pairs.join(classes.select(F.col("class_id").alias("a"), F.col("sigs").alias("sa")), "a").join(classes.select(F.col("class_id").alias("b"), F.col("sigs").alias("sb")), "b")
        return pairs.where(likeness(F.col("sa"), F.col("sb")) >= threshold).select("a", "b")

    heads = posts.groupBy("sig").agg(F.min(F.struct("class_id", "n")).alias("head"), F.count("*").alias("m")).where("m > 1")
    stars = posts.join(heads, "sig").select(F.col("head.class_id").alias("a"), F.col("head.n").alias("na"), F.col("class_id").alias("b"), F.col("n").alias("nb")).where("a <> b")
    links = cut(linked(stars))
    known = components(links, "a", "b")
    labelled = cut(posts.join(known, F.col("class_id") == F.col("node"), "left").select("sig", "class_id", "n", F.coalesce("component", "class_id").alias("label")))
    mixed = labelled.groupBy("sig").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi")
    some = labelled.join(mixed.select("sig"), "sig", "left_semi")
    a, b = (some.select("sig", F.col("class_id").alias(x), F.col("n").alias("n" + x), F.col("label").alias("l" + x)) for x in "ab")
    rest = a.join(b, "sig").where("a < b and la <> lb").select("a", "na", "b", "nb")
    found = components(links.unionByName(linked(rest)), "a", "b")
    return member.join(found, F.col("class_id") == F.col("node"), "left").select("doc_id", "class_id", F.coalesce("component", "class_id").alias("component_id"))
