"""creditspark.streaming"""
