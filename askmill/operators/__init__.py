"""askmill.operators"""
