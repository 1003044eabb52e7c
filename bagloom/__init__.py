"""bagloom: nested ("bag") analytics compiled to Spark DataFrame plans."""
