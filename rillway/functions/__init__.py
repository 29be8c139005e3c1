from rillway.functions.coerce import coerce_column, to_float, to_long, to_text
from rillway.functions.script import js_number, js_string, truthy

__all__ = ["coerce_column", "to_float", "to_long", "to_text", "js_number", "js_string", "truthy"]
