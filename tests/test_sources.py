from pyspark.sql import functions as F

from genoloom.sources import readers as R
from genoloom.sources import writers as W


def put(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def test_fasta(spark, tmp_path):
    p = put(tmp_path, "a.fa", ">s1 first one\nACGT\nAC\n>s2\nGG\n\n>s3 x>y\nT\n")
    assert rows(R.read_fasta(spark, p), "seq_id", "description", "seq") == [("s1", "s1 first one", "ACGTAC"), ("s2", "s2", "GG"), ("s3", "s3 x>y", "T")]


GFF = (
    "##gff-version 3\n##sequence-region r1 1 900\n"
    "r1\tx\tgene\t<10\t90\t.\t+\t.\tID=g1;Name=a%3Bb;Note=one;and more;Note=two\n"
    "r1\tx\tCDS\t10\t90\t5.5\t-\t0\tID=c1;Parent=g1,g2\n"
    "r1\tx\tCDS\t90\t10\t.\t*\t7\tID=bad\n"
    "short\tline\n##FASTA\n>r1\nACGT\n"
)


def test_gff3(spark, tmp_path):
    p = put(tmp_path, "a.gff3", GFF)
    got = {r.feature_id: r for r in R.read_gff3(spark, p).collect()}
    assert (got["g1"].start, got["g1"].stop, got["g1"].strand, got["g1"].attrs["Name"]) == (9, 90, 1, ["a;b"])
    assert got["g1"].attrs["Note"] == ["one;and more", "two"] and got["g1"]["_error"] == ""
    assert got["c1"].parents == ["g1", "g2"] and got["c1"].score == 5.5 and got["c1"].phase == 0
    assert got["bad"]["_error"] == "start after end; strand; phase" and "not nine columns" in got[None]["_error"]
    assert {tuple(r) for r in R.read_gff3_regions(spark, p).where("record_id = 'r1'").collect()} == {("r1", 900)}
    features, seqs = R.split_gff_fasta(spark, p)
    assert rows(seqs, "seq_id", "seq") == [("r1", "ACGT")] and features.where("feature_id = 'c1'").count() == 1


def test_merge_split_locations(spark):
    df = spark.createDataFrame([("r", "a", "CDS", 1, 5, 1), ("r", "a", "CDS", 9, 12, 1), ("r", "b", "CDS", 1, 2, 1), ("r", "b", "gene", 3, 4, 1)], "record_id string, feature_id string, type string, start long, stop long, strand int")
    assert rows(R.merge_split_locations(df), "feature_id", "start", "stop", F.size("parts"), "_error") == [("a", 1, 12, 2, None), ("b", 1, 4, 2, "types differ")]


def test_blast_xml(spark, tmp_path):
    hsp = "<Hsp><Hsp_bit-score>50.5</Hsp_bit-score><Hsp_evalue>1e-5</Hsp_evalue><Hsp_query-from>1</Hsp_query-from><Hsp_query-to>9</Hsp_query-to><Hsp_hit-from>3</Hsp_hit-from><Hsp_hit-to>11</Hsp_hit-to><Hsp_identity>8</Hsp_identity><Hsp_align-len>9</Hsp_align-len></Hsp>"
    hit = f"<Hit><Hit_id>i</Hit_id><Hit_def>t [O]</Hit_def><Hit_accession>A1</Hit_accession><Hit_len>40</Hit_len><Hit_hsps>{hsp}{hsp}</Hit_hsps></Hit>"
    p = put(tmp_path, "a.xml", f'<?xml version="1.0"?>\n<BlastOutput><BlastOutput_iterations><Iteration><Iteration_query-ID>q</Iteration_query-ID><Iteration_query-len>30</Iteration_query-len><Iteration_hits>{hit}</Iteration_hits></Iteration></BlastOutput_iterations></BlastOutput>')
    assert rows(R.read_blast_xml(spark, p), "query", "hsp_no", "accession", "qlen", "slen", "evalue", "nident") == [("q", 0, "A1", 30, 40, 1e-05, 8), ("q", 1, "A1", 30, 40, 1e-05, 8)]


def test_blocks_and_clusters(spark, tmp_path):
    x = put(tmp_path, "a.xmfa", "> 0:1-8 - c0\nACG\nTAC-T\n> 1:1-8 + c1\nTTTTTTTT\n=\n> 0:3-8 + c2\nACGTAC\n=\n")
    assert rows(R.read_xmfa(spark, x), "lcb", "member", "start", "stop", "strand", "seq") == [(1, 0, 0, 8, -1, "ACGTAC-T"), (1, 1, 0, 8, 1, "TTTTTTTT"), (2, 0, 2, 8, 1, "ACGTAC")]
    b = put(tmp_path, "a.bb", "seq0_leftend\tseq0_rightend\tseq1_leftend\tseq1_rightend\n1\t9\t0\t0\n10\t20\t-5\t-15\n")
    assert rows(R.read_backbone(spark, b), "block", "genome", "start", "stop") == [(1, 0, 1, 9), (2, 0, 10, 20), (2, 1, -5, -15)]
    c = put(tmp_path, "a.clstr", ">Cluster 0\n0\t9aa, >p1... *\n1\t8aa, >p2... at 90%\n>Cluster 1\n0\t3aa, >p3... *\n")
    assert rows(R.read_cdhit(spark, c), "cluster_id", "member", "representative") == [("0", "p1", True), ("0", "p2", False), ("1", "p3", True)]
    assert rows(R.read_cluster_lines(spark, put(tmp_path, "a.txt", "a b c\nd e\n")), "cluster", "member") == [("a", "a"), ("a", "b"), ("a", "c"), ("d", "d"), ("d", "e")]


def test_gene_calls(spark, tmp_path):
    g = put(tmp_path, "g.txt", ">rec1 text\norf00001 900 1 -1 8.5\norf00002 5 50 +2 3.0\norf00003 980 40 +1 2.0\n")
    lengths = spark.createDataFrame([("rec1", 1000)], "record_id string, length long")
    assert rows(R.read_glimmer(spark, g, lengths).where("type = 'gene'"), "feature_id", "start", "stop", "strand") == [("orf00001", 0, 900, -1), ("orf00002", 4, 50, 1), ("orf00003_truncated", 979, 1000, 1)]
    m = put(tmp_path, "m.txt", "# rec9\n# gc = 0.5\n# self: -\ngene_1\t10\t90\t+\t0\t11\t5.0\tp\t1\t6\t2.0\ngene_2\t100\t200\t-\t0\t11\t5.0\tp\t-\t-\t-\n")
    got = rows(R.read_mga(spark, m), "feature_id", "type", "start", "stop")
    assert ("gene_1", "gene", 0, 90) in got and ("gene_1.rbs", "Shine_Dalgarno_sequence", 0, 6) in got and ("gene_2", "gene", 99, 200) in got and len(got) == 5
    t = put(tmp_path, "t.txt", "Sequence\tn\nname\t1\t50\t20\tAla\tTGC\t0\t0\t60.1\n")
    assert rows(R.read_trnascan(spark, t), "record_id", "start", "stop", "strand", "product") == [("name", 19, 50, -1, "Ala")]


def test_reads_and_tables(spark, tmp_path):
    s = put(tmp_path, "a.sam", "@HD\tVN:1\nr1\t0\tref\t5\t9\t4M2D3M1I\t*\t0\t0\tACGT\t*\nr2\t16\tref\t10\t9\t5M\t*\t0\t0\tACGT\t*\nr3\t4\t*\t0\t0\t*\t*\t0\t0\tA\t*\n")
    assert rows(R.read_sam_starts(spark, s), "record_id", "strand", "start", "stop") == [("ref", -1, 9, 14), ("ref", 1, 4, 13)]
    f = put(tmp_path, "a.tbl", ">Feature r1\n10\t90\tgene\n\t\t\tlocus_tag\tL1\n90\t10\tCDS\n\t\t\tproduct\tp 1\n\t\t\tnote\tn\n")
    assert rows(R.read_five_column(spark, f), "type", "start", "stop", "strand", F.try_element_at("attrs", F.lit("product"))) == [("CDS", 9, 90, -1, "p 1"), ("gene", 9, 90, 1, None)]
    assert rows(R.read_term_dictionary(spark, put(tmp_path, "a.json", '{"a": ["x", "y"], "b": ["z"]}')), "category", "term") == [("a", "x"), ("a", "y"), ("b", "z")]
    assert rows(R.read_gaf(spark, put(tmp_path, "a.gaf", "# gene\tgo_id\ng1\tGO:1\n")), "gene", "go_id") == [("g1", "GO:1")]
    assert rows(R.read_gene_table(spark, put(tmp_path, "a.tsv", "r\ts\te\tn\nx\t9\t3\ta;b\n"), "r", "s", "e", "n"), "start", "stop", "strand", "name") == [(2, 9, -1, "a%3Bb")]
    assert R.read_genome_hits(spark, put(tmp_path, "h.tab", "#c\nq\t9\t8\t10\t10\tt\ta;b\t1;2\n")).first().identities == 8


def test_genbank(spark, tmp_path):
    text = (
        "LOCUS       AB1  20 bp DNA linear PHG 01-JAN-2020\nSOURCE      Phage X\n  ORGANISM  Phage X\n            Viruses; Y.\nFEATURES             Location/Qualifiers\n"
        "     gene            3..9\n                     /locus_tag=\"t1\"\n     CDS             complement(join(3..5,\n                     7..9))\n                     /product=\"long\n                     name\"\n                     /pseudo\nORIGIN\n        1 acgtacgtac gtacgtacgt\n//\n"
    )
    records, features = R.read_genbank(spark, put(tmp_path, "a.gb", text))
    assert rows(records, "record_id", "organism", "taxonomy", "date", "seq") == [("AB1", "Phage X", "Viruses; Y.", "01-JAN-2020", "ACGTACGTACGTACGTACGT")]
    assert rows(features, "type", "start", "stop", "strand", F.try_element_at("attrs", F.lit("product"))) == [("CDS", 2, 9, -1, ["long name"]), ("gene", 2, 9, 1, None)]


def test_partitioned_sink(spark, tmp_path):
    df = spark.createDataFrame([("r1", "a"), ("r2", "b"), ("r1", "c")], "record_id string, line string")
    W.write_partitioned(df, str(tmp_path / "out"), "record_id")
    back = spark.read.text(str(tmp_path / "out"))
    assert {(r.record_id, r.value) for r in back.collect()} == {("r1", "a"), ("r2", "b"), ("r1", "c")}
    W.write_tsv(df, str(tmp_path / "tsv"))
    assert spark.read.csv(str(tmp_path / "tsv"), sep="\t", header=True).count() == 3


def test_repeated_qualifiers_records_of_a_file_and_split_locations(spark, tmp_path):
    f = put(tmp_path, "b.tbl", ">Feature r1\n1\t9\tCDS\n\t\t\tdb_xref\tx:1\n\t\t\tdb_xref\tx:2\n")
    assert R.read_five_column(spark, f).select("qualifiers").first()[0] == {"db_xref": ["x:1", "x:2"]}
    line = "\t".join(["gene_1", "1", "90", "+", "0", "11", "9.5", "p", "-", "-", "-"])
    m = put(tmp_path, "a.mga", f"# recA some words\n# gc = 0.5, rbs = 0.4\n# self: -\n{line}\n# recB\n# gc = 0.4\n# self: a\n{line}\n")
    assert sorted(r.record_id for r in R.read_mga(spark, m).where("type = 'CDS'").collect()) == ["recA", "recB"]
    g = put(tmp_path, "a.gbk", 'LOCUS       q1 30 bp DNA\nFEATURES             Location/Qualifiers\n     CDS             join(J00194.1:100..202,1..9,\n                     <12..>20)\n                     /gene="x"\n     gene            J00194.1:5..6\nORIGIN\n        1 acgt\n//\n')
    got = [(r.type, r.start, r.stop, [tuple(p) for p in r.parts]) for r in R.read_genbank(spark, g)[1].orderBy("n").collect()]
    assert got == [("CDS", 0, 20, [(0, 9, 1), (11, 20, 1)]), ("gene", None, None, [])]


def test_gff3_is_written_from_the_top_of_the_tree(spark, tmp_path):
    from genoloom.sources import writers as W

    rows_ = [("r", "exon", 0, 9, 1, "e", "m"), ("r", "mRNA", 0, 90, 1, "m", "g"), ("r", "gene", 0, 90, 1, "g", None), ("r", "CDS", 0, 9, 1, "c", "e")]
    f = spark.createDataFrame(rows_, "record_id string, type string, start long, stop long, strand int, feature_id string, parent string").withColumn("attrs", F.create_map().cast("map<string,array<string>>"))
    W.write_gff3(f, str(tmp_path / "out"))
    text = [r.value for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert [x.split("\t")[2] for x in text] == ["gene", "mRNA", "exon", "CDS"]


def test_genbank_text_rules(spark, tmp_path):
    text = (
        'LOCUS       g1 30 bp DNA\nFEATURES             Location/Qualifiers\n     CDS             join(complement(1..3),7..9)\n'
        '                     /translation="MKV\n                     LLA"\n                     /note="says ""hi"" and\n                     /not_a_key=1 ends"\n                     /codon_start=2\n'
        '     CDS             complement(join(3..5,7..9))\n                     /gene=x\n     gene            complement(4..>8)\n     CDS             join(25..30,1..4)\nORIGIN\n        1 acgt\n//\n'
    )
    got = R.read_genbank(spark, put(tmp_path, "t.gb", text))[1].orderBy("n").collect()
    assert [(r.type, r.start, r.stop, r.strand, [tuple(p) for p in r.parts]) for r in got] == [
        ("CDS", 0, 9, 0, [(0, 3, -1), (6, 9, 1)]), ("CDS", 2, 9, -1, [(6, 9, -1), (2, 5, -1)]), ("gene", 3, 8, -1, [(3, 8, -1)]), ("CDS", 0, 30, 1, [(24, 30, 1), (0, 4, 1)]),
    ]
    assert got[0].attrs == {"translation": ["MKVLLA"], "note": ['says "hi" and /not_a_key=1 ends'], "codon_start": ["2"]} and got[1].attrs == {"gene": ["x"]}


def test_parts_go_through_writers_and_readers(spark, tmp_path):
    parts = [("r", "f1", "CDS", 2, 40, -1, [(30, 40, -1), (2, 9, -1)]), ("r", "f2", "CDS", 0, 50, 1, [(45, 50, 1), (0, 7, 1)]), ("r", "f3", "gene", 3, 6, 1, None)]
    schema = "record_id string, feature_id string, type string, start long, stop long, strand int, parts array<struct<start:bigint,stop:bigint,strand:int>>"
    f = spark.createDataFrame(parts, schema).withColumn("attrs", F.create_map(F.lit("k"), F.array(F.lit("v")))).withColumn("parent", F.lit(None).cast("string"))
    text = ">Feature r\n" + "\n".join(r.line for r in W.five_column_lines(f).orderBy("feature_id").collect()) + "\n"
    back = R.read_five_column(spark, put(tmp_path, "p.tbl", text)).orderBy("n").collect()
    assert [[tuple(p) for p in r.parts] for r in back] == [[(30, 40, -1), (2, 9, -1)], [(45, 50, 1), (0, 7, 1)], [(3, 6, 1)]]
    W.write_gff3(f, str(tmp_path / "gff"))
    merged = R.merge_split_locations(R.read_gff3(spark, str(tmp_path / "gff"))).orderBy("feature_id").collect()
    assert [[tuple(p) for p in r.parts] for r in merged] == [[(30, 40, -1), (2, 9, -1)], [(0, 7, 1), (45, 50, 1)], [(3, 6, 1)]]


def test_genbank_references(spark, tmp_path):
    from genoloom.operators.editing import record_references

    text = (
        "LOCUS       g1.2 30 bp DNA\nREFERENCE   1  (bases 1 to 30)\n  AUTHORS   A,B. and\n            C,D.\n  TITLE     A title\n  JOURNAL   J 1\n   PUBMED   77\n"
        "REFERENCE   2\n  AUTHORS   E,F.\n  REMARK    said\nCOMMENT     none\nFEATURES             Location/Qualifiers\n     CDS             1..9\nORIGIN\n        1 acgt\n//\nLOCUS       g2 4 bp DNA\nFEATURES             Location/Qualifiers\nORIGIN\n        1 acgt\n//\n"
    )
    records, _ = R.read_genbank(spark, put(tmp_path, "r.gb", text))
    assert sorted(tuple(r) for r in record_references(records).collect()) == [("g1", 1, "A,B. and C,D.", "A title", "J 1", "", "77", ""), ("g1", 2, "E,F.", "", "", "", "", "said")]
    assert record_references(records, first=True).count() == 1 and {r.record_id: r.comment for r in records.collect()} == {"g1.2": "none", "g2": None}
