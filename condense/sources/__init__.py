"""Inputs and outputs: texts, rule files, repositories, transcripts, stored originals."""
