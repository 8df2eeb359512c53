from meshquery.sources import xml_files


def test_files_are_cut_at_entries(spark, tmp_path):
    (tmp_path / "a.xml").write_text(
        '<?xml version="1.0"?>\n<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">\n<url><loc> https://a.test/?x=1&amp;y=2 </loc><lastmod>2024-02-03</lastmod><priority>0.8</priority></url>'
        "<url>\n<loc>https://a.test/é</loc>\n<priority>high</priority>\n</url><url></url><url><loc></loc></url></urlset>"
    )
    (tmp_path / "b.xml").write_text("<sitemapindex><sitemap><loc>https://a.test/s.xml</loc><lastmod>2024-02-03T04:05:06Z</lastmod></sitemap></sitemapindex>")
    (tmp_path / "c.xml").write_text("")
    got = sorted((r.url, str(r.lastmod), r.priority) for r in xml_files.sitemap_files(spark, str(tmp_path)).collect())
    assert got == [("https://a.test/?x=1&y=2", "2024-02-03 00:00:00", 0.8), ("https://a.test/s.xml", "2024-02-03 04:05:06", 1.0), ("https://a.test/é", "None", 0.5)]
    (tmp_path / "feeds").mkdir()
    (tmp_path / "feeds" / "r.xml").write_text("<rss><channel><title>T</title><item><title>One</title><link>https://a.test/1</link><pubDate>Mon</pubDate><description><![CDATA[<b>x</b>]]></description></item><item><guid>g2</guid></item></channel></rss>")
    (tmp_path / "feeds" / "a.xml").write_text('<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>Two</title><link href="https://a.test/2"/><updated>2024</updated><summary>s</summary></entry></feed>')
    got = sorted(map(str, ((r.title, r.url, r.published, r.summary) for r in xml_files.feed_files(spark, str(tmp_path / "feeds")).collect())))
    assert got == ["('One', 'https://a.test/1', 'Mon', '<b>x</b>')", "('Two', 'https://a.test/2', '2024', 's')", "(None, 'g2', None, None)"]


def test_one_large_file_is_read_by_many_tasks(spark, tmp_path):
    (tmp_path / "big.xml").write_text("<urlset>" + "".join(f"<url><loc>https://a.test/{i}</loc></url>\n" for i in range(60_000)) + "</urlset>")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300000")
    try:
        found = xml_files.entries(spark, str(tmp_path), "url", "loc string")
        assert found.rdd.getNumPartitions() > 5 and found.select("loc").distinct().count() == 60_000 == found.count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
