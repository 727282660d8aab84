"""Document knowledge graphs and text analytics as DataFrame plans."""
