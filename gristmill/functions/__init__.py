"""Column functions: text, HTML, rules, features, spans, secrets, urls."""
