"""From source text to facts: captures by language, and what is made of them."""
