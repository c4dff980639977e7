"""Column builders: text, PII, scores, URLs, HTML and arrays. All run inside the JVM."""
