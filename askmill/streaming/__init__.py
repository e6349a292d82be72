"""askmill.streaming"""
