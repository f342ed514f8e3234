"""Extraction, rules, scores, query layer, graph, tree, generators and exports."""
