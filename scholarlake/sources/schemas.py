"""Explicit schemas of the raw documents. Scalars are read as strings and cast, since numbers may arrive quoted."""

AUTHOR = """data struct<
  scholar_id: string, name: string, affiliation: string, email_domain: string,
  hindex: string, hindex5y: string, citedby: string, citedby5y: string, i10index: string, i10index5y: string>"""
AUTHOR_PUBLICATIONS = """data struct<scholar_id: string, publications: array<struct<
  author_pub_id: string, num_citations: string, filled: boolean, bib: struct<pub_year: string>>>>"""
AUTHOR_COAUTHORS = """data struct<scholar_id: string, name: string, affiliation: string, email_domain: string,
  coauthors: array<struct<scholar_id: string, name: string, affiliation: string>>>"""
PUBLICATION = """data struct<author_pub_id: string,
  bib: struct<title: string, author: string, citation: string, pub_year: string>,
  num_citations: string, cites_per_year: string, url_related_articles: string>"""
