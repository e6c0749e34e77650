"""Schemas of the tables between stages."""

RAW = "url string, html string, statusCode int, fetchedAt string, contentType string, depth int"
BLOCK = "struct<type:string,content:string,headingPath:array<string>>"
HEADING = "struct<level:int,text:string>"
CLEANED = f"url string, title string, headings array<{HEADING}>, textBlocks array<{BLOCK}>, cleanedAt string, sourceHash string, depth int"
CHUNK = "chunk_id string, doc_id string, text string, token_count long, source_url string, page_title string, section_heading string, heading_path array<string>, content_type string, crawled_at string, language string, is_boilerplate boolean, chunk_index int, chunk_count long, source_hash string"
INDEXED = "chunk_id string, vector array<float>, doc_id string, source_url string, page_title string, section_heading string, heading_path string, content_type string, token_count long, chunk_index int, chunk_count long, crawled_at string, language string, source_hash string, text string"
SITEMAP = "url string, lastmod string"
SNAPSHOT = "url string, lastmod string, lastModified string, contentHash string, lastFetchedAt string"
#: A snapshot of another version counts as none.
SNAPSHOT_VERSION = 1
FACT = "id string, triggers array<string>, content string, source_url string, source_title string, priority int, grp string"
