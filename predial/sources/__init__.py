"""Tables of listings: views, schemas, pages, search results, sinks."""
