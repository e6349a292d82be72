"""askmill.sources"""
